"""The registered training-data queries, and the pipeline against a plain composition."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from epimill.llm import lines, quality, secrets, simhash
from epimill.llm.queries import ORACLES, QUERIES, tokenizer

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, SF_DIR, name, QUERIES[name], ORACLES.get(name)) == ""


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    # by hand: languages keep all lettered texts, then lines, copies and secrets
    named = {i: r for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    pages, on_pages = {}, {}
    for r in named.values():
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for line in {x.strip(" ") for x in r["text"].split("\n")} - {""}:
            on_pages[r["source"], line] = on_pages.get((r["source"], line), 0) + 1
    gone = {k for k, n in on_pages.items() if n >= lines.MIN_PAGES and n > lines.MAX_RATIO * pages[k[0]]}
    for r in named.values():
        r["text"] = "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in gone)
    prints = {i: simhash.fingerprint(r["text"], 4) for i, r in named.items()}
    group = {i: i for i in named}
    changed = True
    while changed:
        changed = False
        for i in sorted(named):
            best = min(group[j] for j in named if bin(prints[i] ^ prints[j]).count("1") <= 4)
            changed |= best < group[i]
            group[i] = min(group[i], best)
    kept = {i for i in named if group[i] == i}

    state, results = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, SF_DIR)
        results[name] = state
        if name != "best_fit_packing":
            assert state.columns == docs.columns
    assert {r["doc_id"] for r in results["language_id"].collect()} == set(named)
    texts = {r["doc_id"]: r for r in results["line_dedup"].collect()}
    assert {i: r["text"] for i, r in texts.items()} == {i: r["text"] for i, r in named.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert {r["doc_id"] for r in results["simhash_near_dedup"].collect()} == kept
    scanned = results["secret_scan"]
    assert scanned.count() == len(kept)
    assert not [r for r in secrets.find_secrets(scanned).collect() if r["spans"]]
    packed = results["best_fit_packing"].collect()
    assert {r["doc_id"] for r in packed} == kept
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(packed)


def test_language_stage_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = ["Это текст на языке, которого модель не знает. " * 6, "zxqj vkwp qqzx jjkv wxzq pvvk zzqx. " * 9, "a " + "12345 !!! ### 999 " * 40]
    strange.append("Questo testo non appartiene alle lingue imparate e quindi deve essere scartato. " * 5)
    added = spark.createDataFrame([(10**9 + 4 * i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    added = added.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    kept = corpus_pipeline.language_id(spark, docs.unionByName(added, allowMissingColumns=True), "")
    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in lettered.select("doc_id").collect()}


def test_language_stage_learns_from_all_labelled_rows(spark):
    """What only rows beyond the least hashes of a language show is learned, and sets the bounds."""
    rng = np.random.default_rng(3)
    words = [["".join(rng.choice(list(letters), 5)) for _ in range(300)] for letters in ("abcdefghijklm", "бвгдежзиклмно")]

    def text(script):
        return " ".join(rng.choice(words[script], 80))

    hashed = spark.range(1200).select("id", F.xxhash64(F.col("id")).alias("hash"), F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2)
    ids = [r[0] for r in sorted(hashed.collect(), key=lambda r: (r[2], r[1]))]  # those not held out by hash, then the others
    rows = [(i, text(int(at > 700)), "xx", "s", None) for at, i in enumerate(ids)]
    rows += [(2000, "Ωμέγα ψυχή θάλασσα ουρανός ξύλο " * 15, None, "s", None)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(ids)


def test_pipeline_stages_keep_columns_that_are_not_theirs(spark):
    names = ["score", "Lang_Pred", "rate", "n_lines", "n_removed", "secret_spans", "spans", "simhash", "component_id", "kept", "own_0"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF_DIR)
        assert made.columns == docs.columns, name
        rows = made.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names), name


def test_registered_digests(spark):
    """The columns that the queries derive from the operators, by hand, over whole tables."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    library = Tokenizer.from_file(tokenizer())
    library.no_truncation(), library.no_padding()
    ids = {i: library.encode(r["text"] or "", add_special_tokens=False).ids for i, r in docs.items()}

    start = 0
    files = {r["doc_id"]: r for r in QUERIES["op8_token_files"](spark, SF_DIR).collect()}
    for i in sorted(docs):
        own = np.array([*ids[i], 1], "<u4")
        assert (files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)

    pieces, bins = {}, {}
    for r in QUERIES["op9_packing"](spark, SF_DIR).collect():
        pieces[r["doc_id"], r["piece"]] = r
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i in docs:
        own = np.array([*ids[i], 0], "<u4")
        for n, at in enumerate(range(0, len(own), 2048)):
            r, part = pieces.pop((i, n)), own[at : at + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    for places in bins.values():
        places.sort()
        ends = np.cumsum([length for _, length in places])
        assert [at for at, _ in places] == [0, *ends[:-1]] and ends[-1] <= 2048

    for r in QUERIES["op2_language"](spark, SF_DIR).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1

    blank = re.compile("[\x20\x09-\x0d]+")
    for r in QUERIES["op7_quality"](spark, SF_DIR).collect():
        text = docs[r["doc_id"]]["text"] or ""
        found = [w for w in blank.split(text) if w]
        windows = Counter(tuple(found[k : k + 8]) for k in range(len(found) - 7))
        repeated = {k + j for k in range(len(found) - 7) if windows[tuple(found[k : k + 8])] > 1 for j in range(8)}
        worded = [x for x in text.split("\n") if blank.sub("", x)]
        counts = len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(repeated)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        failed = len(found) < 20 or 100 * len(repeated) > 30 * len(found)
        lost = sum(len(blank.sub("", x)) for x in worded if quality.line_fails(x))
        assert r["base_failed"] == failed and r["kept"] == (not failed and 2 * lost <= counts[1])


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
