"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epimill.llm import bpe, divergence, language, lines, lm, merkle, packing, quality, rans, repeats, secrets, simhash, topk
from epimill.llm.registry import ORACLES, QUERIES, query
from epimill.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]

WORD_BPE = "word_bpe_49k.json"
END_OF_DOCUMENT = 1
END_OF_PACKED = 0


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def tokenizer() -> str:
    return public_tokenizers.path(WORD_BPE)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf_dir), tokenizer())
    digests = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        "ids",
    )
    decoded = bpe.decode(digests, tokenizer())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    rans.write_tokens(documents(spark, sf_dir), folder, tokenizer(), END_OF_DOCUMENT)
    return rans.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer(), end_id=END_OF_PACKED)


def held_out() -> Column:
    """Whether a document is kept out of all training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = documents(spark, sf_dir, "doc_id", "text", "lang").filter(~held_out())
    model = language.train(labelled)
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out().alias("held_out"))
    return language.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


SHINGLE_WORDS = 4
MAX_BITS = 4


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), SHINGLE_WORDS, MAX_BITS)
    hexed = F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", hexed, "component_id")


NEAREST = 5
TOP_K_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op6_top_k", TOP_K_SQL)
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, NEAREST)


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(documents(spark, sf_dir), with_clean=False)


LINE_SQL = f"""
WITH pages AS (
  SELECT doc_id, source, text, coalesce('=' || source, '') AS site FROM documents
), totals AS (
  SELECT site, count(*) AS pages FROM pages GROUP BY site
), on_page AS (
  SELECT site, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM pages
), found AS (
  SELECT site, line FROM on_page JOIN totals USING (site) WHERE line <> ''
  GROUP BY site, line, pages HAVING count(*) >= {lines.MIN_PAGES} AND count(*) > {lines.MAX_RATIO} * pages
), lists AS (
  SELECT site, list(line) AS gone FROM found GROUP BY site
), kept AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(gone, []), trim(x))) AS stay
  FROM pages LEFT JOIN lists USING (site)
)
SELECT doc_id, source, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(stay), 0) AS n_removed,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(stay, chr(10)), '') END AS text
FROM kept
"""


@query("op4_line_dedup", LINE_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    return lines.drop_boilerplate(docs, "source").select("doc_id", "source", "n_lines", "n_removed", "text")


def secrets_sql() -> str:
    """The spans by DuckDB: every rule on every text, without an index."""
    columns, starts = [], []
    for number, rule in enumerate(secrets.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        columns.append(
            f"regexp_extract_all(body, {pattern}, 0) AS m{number}, "
            f"regexp_extract_all(body, {pattern}, {rule.group}) AS g{number}, "
            f"string_split_regex(body, {pattern}) AS gap{number}"
        )
        at = f"list_sum(list_transform(gap{number}[:i], lambda x: length(x))) + "
        at += f"coalesce(list_sum(list_transform(m{number}[:i-1], lambda x: length(x))), 0)"
        starts.append(
            f"list_transform(list_filter(generate_series(1, len(m{number})), "
            f"lambda i: length(g{number}[i]) >= {rule.least}), "
            f"lambda i: {{'start': CAST({at} AS BIGINT), 'number': {number}, 'kind': '{rule.kind}', "
            f"'end': CAST({at} + length(m{number}[i]) AS BIGINT)}})"
        )
    all_spans = "list_sort(flatten([" + ", ".join(starts) + "]))"
    text_of = "coalesce(array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start || ':' || s.end), ','), '')"
    base = "list_filter(found, lambda s: s.number < 3)"
    counts = ", ".join(
        f"len(list_filter(found, lambda s: s.number = {i})) AS n_{r.kind}" for i, r in enumerate(secrets.BASE_RULES)
    )
    return (
        f"WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), "
        f"parts AS (SELECT doc_id, {', '.join(columns)} FROM docs), "
        f"spans AS (SELECT doc_id, {all_spans} AS found FROM parts) "
        f"SELECT doc_id, {counts}, sha256({text_of.format(base)}) AS base_sha256, {text_of.format('found')} AS spans FROM spans"
    )


def _equals(kind: str) -> Callable[[Column], Column]:
    return lambda k: F.when(k == kind, k)


@query("op10_secrets", secrets_sql())
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    base_kinds = [r.kind for r in secrets.BASE_RULES]
    base = F.filter(F.col("spans"), lambda s: s["kind"].isin(base_kinds))
    kinds = F.transform(F.col("spans"), lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _equals(k)))).cast("long").alias(f"n_{k}") for k in base_kinds]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


@query("op3_repeats")
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_merkle")
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = documents(spark, sf_dir, *fields)
    changed = F.regexp_replace("text", "\n", "")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select(
        "doc_id",
        "source",
        merkle.digest_of([F.col(c) for c in fields]).alias("leaf"),
        F.when(tampered, merkle.digest_of([*[F.col(c) for c in fields[:-1]], changed])).alias("changed"),
    )
    built = merkle.manifest(leaves, carry=["changed"])
    proof = F.sha2(F.array_join(F.flatten("proof"), ""), 256)
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("proof"), F.col("places"))
    shown = built.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


DIVERGENCE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
), found AS (
  SELECT row, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS of_lang FROM found GROUP BY ALL HAVING count(DISTINCT row) >= {divergence.MIN_DOCUMENTS}
), used AS (
  SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, count(*) AS v, sum(of_lang) AS in_lang FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v, coalesce(in_lang, 0)::HUGEINT AS in_lang
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL) t USING (lang, source) LEFT JOIN sizes USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(u.n, 0) + 2) // (g.total + 2 * g.v) AS p,
    1 + 1000000000::HUGEINT * (k.of_lang + 2) // (g.in_lang + 2 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)
), priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM items
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.SHOWN}
"""


@query("op12_divergence", DIVERGENCE_SQL)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir, "text", "lang", "source"))


@query("op13_lm")
def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = lm.score(documents(spark, sf_dir), ~apart)
    shown = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), *shown)
