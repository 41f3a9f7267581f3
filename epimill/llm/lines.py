"""Boilerplate lines by their frequency on a site; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epimill.llm.common import fresh, stored

MAX_RATIO = 0.05
MIN_PAGES = 5


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _site_key(site: Column) -> Column:
    """A text that is never null: pages without a site are a site of their own."""
    return F.when(site.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), site.cast("string")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, site: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(site_key, line): lines on more than ``max_ratio`` of their site's pages and at least ``min_pages``.

    Lines are first counted by a 64-bit hash, which shuffles a few bytes per line after a
    partial sum. Only lines whose hash is frequent are then counted as texts, so a collision
    cannot make a line frequent.
    """
    keyed = pages.select(_site_key(F.col(f"`{site}`")).alias("site_key"), F.col(f"`{text}`").alias("text"))
    totals = keyed.groupBy("site_key").agg(F.count("*").alias("pages"))
    # a line counts once per page, and blank lines never
    trimmed = F.array_distinct(F.transform(_lines(F.col("text")), lambda line: F.trim(line)))
    exploded = keyed.select("site_key", F.explode(F.filter(trimmed, lambda line: line != "")).alias("line"))
    hashed = exploded.withColumn("hash", F.xxhash64("line"))
    frequent = (F.col("n") >= min_pages) & (F.col("n") > F.lit(max_ratio) * F.col("pages"))
    by_hash = hashed.groupBy("site_key", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    likely = by_hash.join(totals, "site_key").filter(frequent).select("site_key", "hash", "pages")
    likely = stored(likely, "likely-lines")
    exact = hashed.join(likely, ["site_key", "hash"]).groupBy("site_key", "line")
    return exact.agg(F.count("*").alias("n"), F.first("pages").alias("pages")).filter(frequent).select("site_key", "line")


def drop_boilerplate(
    pages: DataFrame, site: str, text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` without the lines that are boilerplate on their site, plus n_lines and n_removed.

    Lines are compared without the blanks around them. A line goes wherever it occurs on the
    site if it is on more than ``max_ratio`` of the site's pages and on at least
    ``min_pages``; repeated rows are pages like others. Blank lines stay. A null text stays
    null with 0 lines; an empty text is one blank line; pages without a site form one site.
    Columns called n_lines or n_removed are replaced.

    A site's boilerplate is bounded by its lines per page over the ratio, so it travels as
    one row per site. Only that table is joined with the pages; if it is small Spark
    broadcasts it by its measured size, else a large site's pages are split by AQE.
    """
    found = boilerplate(pages, site, text, max_ratio, min_pages)
    entry = F.struct(F.xxhash64("line").alias("hash"), "line")
    per_site = stored(found.groupBy("site_key").agg(F.sort_array(F.collect_list(entry)).alias("found")), "boilerplate")
    columns = [c for c in pages.columns if c.lower() not in ("n_lines", "n_removed", text.lower())]
    key, hashes, texts = (fresh(pages, c) for c in ("site_key", "hashes", "texts"))
    lists = per_site.select(F.col("site_key").alias(key), F.col("found.hash").alias(hashes), F.col("found.line").alias(texts))
    joined = pages.withColumn(key, _site_key(F.col(f"`{site}`"))).join(lists, key, "left")
    lines = _lines(F.col(f"`{text}`"))

    def stays(line: Column) -> Column:
        # whole numbers are compared first; texts only where the hash is on the list
        listed = F.array_contains(F.col(hashes), F.xxhash64(F.trim(line))) & F.array_contains(F.col(texts), F.trim(line))
        return ~listed

    kept = F.when(F.col(hashes).isNull(), lines).otherwise(F.filter(lines, stays))
    original = pages.schema.fieldNames()
    kept_column, n_column = fresh(pages, "kept"), fresh(pages, "n")
    counted = joined.withColumn(kept_column, kept).withColumn(n_column, F.coalesce(F.size(lines), F.lit(0)))
    n_lines = F.when(F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(F.col(n_column)).cast("long")
    n_kept = F.when(F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(F.size(kept_column)).cast("long")
    cleaned = F.when(F.col(n_column) == F.size(kept_column), F.col(f"`{text}`")).otherwise(F.array_join(kept_column, "\n"))
    return counted.select(
        *[(cleaned.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`")) for c in original if c in columns or c.lower() == text.lower()],
        n_lines.alias("n_lines"),
        (n_lines - n_kept).alias("n_removed"),
    )
