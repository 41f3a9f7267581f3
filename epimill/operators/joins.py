"""Joins between facts and lookups.

No side is hinted as broadcast. Spark broadcasts a side when its measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges,
splitting skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from epimill.functions.dates import parse_timestamp, timestamp_text
from epimill.functions.texts import is_blank


def one_per_key(lookup: DataFrame, key: str) -> DataFrame:
    """The lookup; two rows that share a key, which would multiply facts, stop the query.

    The rows of a key are counted in the plan itself, dealt by the key as a join wants them,
    so building a query starts no job. Rows without a key match nothing, may repeat and
    are spread by their values.
    """
    apart = F.when(F.col(key).isNull(), F.xxhash64(*lookup.columns))
    rows = F.count("*").over(Window.partitionBy(key, apart))
    said = F.concat(F.lit(f"several lookup rows with {key} "), F.col(key).cast("string"))
    single = F.when(F.col(key).isNotNull() & (F.col("_rows") > 1), F.raise_error(said).cast("boolean")).otherwise(F.lit(True))
    return lookup.withColumn("_rows", rows).where(single).drop("_rows")


def merge_lookups(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join in which a null key matches a null key.

    Written as a left join plus the right rows without a partner. Unlike a full
    join, both can broadcast a small right side and split a hot key of the left.
    """
    other = right.withColumnRenamed(key, "_right_key")
    same = F.col(key).eqNullSafe(F.col("_right_key"))
    matched = left.join(other, same, "left").drop("_right_key")
    keys = left.select(key).distinct()
    alone = other.join(keys, same, "left_anti").withColumnRenamed("_right_key", key)
    return matched.unionByName(alone, allowMissingColumns=True)


def add_lookup(facts: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    return facts.join(lookup, key, "left")


def add_second_fact(facts: DataFrame, other: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Left join on name and date; blank names of the other fact match nothing."""
    return facts.join(other.where(~is_blank(F.col(name))), list(keys), "left")


def having_match(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(distinct_keys(other, key), key, "left_semi")


def without_match(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows without a partner; unlike ``NOT IN``, nulls in the other side are harmless."""
    return df.join(distinct_keys(other, key), key, "left_anti")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of the side that is only looked up, each once, so that a frequent key
    there is reduced before the join.

    Grouping by a hash as well makes the join shuffle the reduced keys anew. Spark
    splits a hot key of the other side only when both sides come from a shuffle of
    the join's own.
    """
    return df.select(key, F.xxhash64(key).alias("_hash")).distinct().select(key)


def add_time_parts(facts: DataFrame, dim_time: DataFrame, stamp: str = "last_update") -> DataFrame:
    """Join the time dimension on the parsed stamp, whichever form its text has."""
    text = timestamp_text(parse_timestamp(F.col(stamp)))
    # an unreadable stamp matches nothing; without a key of its own, all such rows would meet in one task
    text = F.coalesce(text, F.concat(F.lit("unread "), F.xxhash64(*facts.columns).cast("string")))
    parts = dim_time.withColumnRenamed("last_update", "_stamp")
    return facts.withColumn("_stamp", text).join(parts, "_stamp", "left").drop("_stamp")
