"""Merkle manifest, divergence audit and language model against brute force, with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epimill.llm import divergence, gru, lm, merkle, queries
from epimill.llm.registry import ship_package

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `group` int, place int, term string, training int"


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    words = ["alpha", "Beta", "gamma", "ümlaut", "DON'T", "x1y", "中文", "delta"]
    data = []
    for i in range(300):
        text = " ".join(words[(i * k + k * k) % 8] for k in range(i % 17)) + ("\n" if i % 3 else "")
        data.append((i * 977 - 40_000, f"s{i % 4}" if i % 3 else "hot", "en" if i % 5 else "fr", len(text), text))
    data += [data[7]] * 5  # repeated rows
    data += [(data[9][0], data[9][1], "en", 1, "another text of one id")]
    data += [(None, "hot", "en", 3, "no id"), (None, "hot", "en", 4, "no id too")]
    data += [(10**15, None, None, None, None), (10**15 + 1, "", "", 0, ""), (5, "alone", "de", 3, "çà et là")]
    data += [(-7, "s1", "en", 9, "  Alpha \x0b\x0c alpha\x1calpha\x85 \t"), (-8, "s1", "en", 9, "longword" * 20_000 + " alpha" * 5_000)]
    return spark.createDataFrame([(*row, 1, 2, "t", 3) for row in data], SCHEMA).repartition(7)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return sha(*[told(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def merkle_by_hand(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of each row."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append((row["doc_id"], leaf_of(row, row["text"]), row["text"], row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by_source[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = tree([x[1] for x in by_source[name]])
    upper = tree([trees[name][-1][0] for name in names])
    out = []
    for number, name in enumerate(names):
        for i, (key, leaf, text, row) in enumerate(by_source[name]):
            node, beside = leaf, []
            if key is not None and text is not None and zlib.crc32(str(key).encode()) % 2 == 0:
                node = leaf_of(row, text.replace("\n", ""))
            for levels, j in ((trees[name], i), (upper, number)):
                for level in levels[:-1]:
                    run = level[j // 3 * 3 : j // 3 * 3 + 3]
                    beside += run[: j % 3] + run[j % 3 + 1 :]
                    node = sha(*run[: j % 3], node, *run[j % 3 + 1 :])
                    j //= 3
            out.append((key, leaf, trees[name][-1][0], upper[-1][0], sha(*beside), node, node == upper[-1][0]))
    return out


def run_on(spark, tmp_path, docs, name):
    folder = str(tmp_path / "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    return queries.QUERIES[name](spark, folder)


def test_merkle_query(spark, docs, tmp_path, monkeypatch):
    for levels in (2, 6):  # several rounds, and one
        monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], levels))
        got = [tuple(r) for r in run_on(spark, tmp_path / str(levels), docs, "op11_merkle").collect()]
        want = merkle_by_hand([r.asDict() for r in docs.collect()])
        assert Counter(got) == Counter(want)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_merkle_places_and_bounds(spark, docs):
    leaves = docs.withColumn("leaf", F.sha2(F.coalesce("text", F.lit("")), 256))
    built = merkle.manifest(leaves, levels=2)
    rows = built.collect()
    assert len(rows) == docs.count()
    for name in {r["source"] for r in rows}:
        own = sorted((r["place"], r["n"]) for r in rows if r["source"] == name)
        assert own == [(i, len(own)) for i in range(len(own))]
    folded = built.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"), F.col("places")))
    assert folded.where("again <> root").isEmpty()
    lone = next(r for r in rows if r["source"] == "alone")
    assert lone["subroot"] == lone["leaf"]


def test_merkle_on_dense_and_repeated_ids(spark):
    data = spark.range(10_000).select(F.expr("id div 2").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    rows = merkle.manifest(data.repartition(5)).select("doc_id", "leaf", "place", "root").collect()
    order = sorted(rows, key=lambda r: (r["doc_id"], r["leaf"]))
    assert [r["place"] for r in order] == list(range(10_000))
    assert {r["root"] for r in rows} == {tree([r["leaf"] for r in order])[-1][0]}


def test_new_operators_on_an_empty_table(spark, docs, tmp_path):
    for name in ("op11_merkle", "op12_divergence", "op13_lm"):
        assert run_on(spark, tmp_path / name, docs.limit(0), name).collect() == []


def divergence_by_hand(rows, least, shown):
    unit, out = 10**9, []
    found = {}
    for row in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (row["text"] or "").translate(LOWER))
        groups = found.setdefault(row["lang"] or "", {})
        n, documents = groups.setdefault(row["source"] or "", (Counter(), Counter()))
        n.update(terms)
        documents.update(set(terms))
    for lang, groups in found.items():
        documents = sum((d for _, d in groups.values()), Counter())
        kept = sorted((t for t, d in documents.items() if d >= least), key=lambda t: t.encode())
        counts = {s: [n[t] for t in kept] for s, (n, _) in groups.items()}
        total = [sum(c) for c in zip(*counts.values(), strict=True)] if kept else []

        def shares(c):
            return [1 + unit * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        for s in groups:
            pairs = [(sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o], strict=True)), o) for o in groups if o != s]
            terms = [((a - b) ** 2 // (a + b), t) for a, b, t, c in zip(p[s], q, kept, counts[s], strict=True) if c and a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, shown)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return out


@pytest.mark.parametrize(("tile", "columns"), [(128, 1_200), (2, 3)])
def test_divergence(spark, docs, monkeypatch, tile, columns):
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = [r.asDict() for r in docs.collect()]
    for least in (10, 1, 10_000):
        got = [tuple(r) for r in divergence.audit(docs, min_documents=least).collect()]
        assert Counter(got) == Counter(divergence_by_hand(rows, least, 10))


def test_joint_prices_are_split_when_wide(monkeypatch):
    monkeypatch.setattr(divergence, "MOST_COLUMNS", 40)
    counts = np.random.default_rng(3).integers(0, 50, (500, 6))
    total, size, out = counts.sum(0), np.full(6, 500), np.zeros((6, 6), np.int64)
    divergence.joint_price(counts, np.full(6, 2), total, size, out)
    share = [[1 + 10**9 * (int(c) + 2) // (int(total[s]) + 1000) for c in counts[:, s]] for s in range(6)]
    for i in range(6):
        for j in range(i + 1, 6):
            assert out[i, j] == sum((a - b) ** 2 // (a + b) for a, b in zip(share[i], share[j], strict=True))


def test_lm_query(spark, docs, tmp_path):
    got = run_on(spark, tmp_path, docs, "op13_lm").collect()
    rows = [r.asDict() for r in docs.collect()]
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    tokens = [[*re.findall("[^\x20\x09-\x0d]+", (r["text"] or "").translate(LOWER)), None] for r in rows]
    learned = [t for t, h in zip(tokens, held, strict=True) if not h]
    counts = Counter(w for t in learned for w in t)
    total = sum(counts.values())

    def base(t):
        return math.fsum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t)

    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(((r["doc_id"], len(t), sum(counts[w] > 0 for w in t), round(base(t), 6)) for r, t in zip(rows, tokens, strict=True)), key=key)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got), key=key) == want
    assert {r["train_tokens"] for r in got} == {total}
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    same = {round(r["score"], 3) for r in got if r["doc_id"] == rows[7]["doc_id"]}
    assert len(same) == len({r["text"] for r in rows if r["doc_id"] == rows[7]["doc_id"]})


def test_lm_learns_and_needs_no_training_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    apart = F.col("doc_id") % 5 == 0
    scored = lm.score(docs, ~apart, rounds=3).filter(~F.col("training")).agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > scored[1]
    unseen = lm.score(docs, F.lit(None).cast("boolean")).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 and r["score"] <= 0 for r in unseen)


def test_gru_gradient():
    shape = gru.Shape(11, 3)
    rng = np.random.default_rng(1)
    flat = gru.first_weights(shape, np.arange(20, 9, -1)).astype(np.float64) + rng.normal(0, 0.1, shape.size)
    inputs, targets = rng.integers(0, 11, (5, 4)), rng.integers(0, 11, (5, 4))
    state, grad = rng.normal(0, 0.5, (4, 3)), np.zeros(shape.size)
    gru.Gru(shape, flat).gradient(inputs, targets, state, grad)
    unused = np.zeros(shape.size)

    def loss(weights):
        return gru.Gru(shape, weights).gradient(inputs, targets, state, unused)[0]

    for i in range(shape.size):
        step = np.zeros(shape.size)
        step[i] = 1e-3
        slope = (loss(flat + step) - loss(flat - step)) / 2e-3
        assert slope == pytest.approx(grad[i], abs=3e-3 * max(1, abs(grad[i]))), i


def test_scores_are_chances_and_do_not_depend_on_the_others(monkeypatch):
    shape = gru.Shape(7, 4)
    flat = gru.first_weights(shape, np.arange(9, 2, -1))
    one = gru.score(shape, flat, [np.array([w, 0], np.uint16) for w in range(1, 7)])
    first = gru.score(shape, flat, [np.array([0], np.uint16)])[0]
    ends = [gru.Gru(shape, flat)]
    model = ends[0]
    hidden, _ = model.states(np.array([[0]]), np.zeros((1, 4), np.float32))
    chances = [float(model.log_chances(hidden[0], np.array([w]))[0][0]) for w in range(7)]
    assert sum(np.exp(chances)) == pytest.approx(1, abs=1e-5) and first == pytest.approx(chances[0] / np.log(10), abs=1e-5)
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, 7, n), 0).astype(np.uint16) for n in (0, 1, 5, 200, 77, 3)]
    alone = np.array([gru.score(shape, flat, [t])[0] for t in texts])
    monkeypatch.setattr(gru, "LANES", 2)
    assert np.allclose(gru.score(shape, flat, texts), alone, rtol=1e-4)
    assert len(one) == 6 and (one < 0).all()
