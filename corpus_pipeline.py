"""A training-data pipeline over the documents table, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epimill.llm import language, lines, packing, secrets, simhash
from epimill.llm.common import fresh, stored
from epimill.llm.queries import END_OF_PACKED, MAX_BITS, SHINGLE_WORDS, tokenizer
from epimill.llm.registry import ship_package


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of those names, which an operator would replace, under fresh ones."""
    moved = {c: fresh(docs, f"own_{i}") for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(moved), moved


def put_back(docs: DataFrame, changed: DataFrame, moved: dict[str, str], new_text: bool = False) -> DataFrame:
    """The columns of ``docs`` from ``changed``; with a new text, n_chars counts it."""
    columns = {c: F.col(f"`{moved.get(c, c)}`") for c in docs.columns}
    if new_text and "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return changed.select(*[column.alias(c) for c, column in columns.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay.

    Languages are learned from all documents with a text and a label. Texts go that are null or
    have no letter, or that even their best language codes in many more bits than the labelled
    documents need. Repeated rows are judged alike, and stay or go together. All columns stay as
    they are, also those named like the operator's own.
    """
    ship_package(spark)
    model = language.train_on(language.usable(docs))
    rows, moved = set_aside(docs, "lang_pred", "score")
    rates = fresh(rows, "rate"), fresh(rows, "letter_rate")
    rated = stored(language.predict(rows, model, rates=rates), "rated", compression="zstd")
    known = F.col("lang_pred") != language.UNKNOWN
    for rate, bound in zip(rates, language.rate_bounds(language.usable(rated), rates), strict=True):
        known &= F.col(rate) <= bound
    return put_back(docs, rated.filter(known), moved)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate on their source go; all documents stay, repeated rows too.

    A repeated row is a page of its own in the counts. Other columns than text and n_chars stay.
    """
    rows, moved = set_aside(docs, "n_lines", "n_removed")
    return put_back(docs, lines.drop_boilerplate(rows, "source"), moved, new_text=True)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays, of repeated rows one."""
    ship_package(spark)
    return simhash.one_of_each(docs, SHINGLE_WORDS, MAX_BITS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay, repeated rows too, with their other columns."""
    spans = fresh(docs, "spans")
    found = secrets.find_secrets(docs, spans=spans)
    return put_back(docs, found.withColumn("text", secrets.redact(F.col("text"), F.col(spans))), {}, new_text=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document in training sequences; a row for each piece, of repeated rows for each."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer(), end_id=END_OF_PACKED)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

# SimHash and packing cannot be written in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
