"""Aggregations, distinct values and set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def sum_by(df: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Sums by key, as new name → summed column; integers are summed as bigint."""
    return df.groupBy(*keys).agg(*[F.sum(column).alias(name) for name, column in sums.items()])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values without null."""
    return distinct_values(df.where(F.col(column).isNotNull()), column)


def with_next_day(days: DataFrame, column: str) -> DataFrame:
    """A set of dates plus the day after its latest."""
    following = days.agg(F.date_add(F.max(column), 1).alias(column))
    return days.select(column).unionByName(following.where(F.col(column).isNotNull()))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def only_in_one(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Values found on exactly one side, as (value, only_in).

    Both inputs hold one column. One grouped pass instead of two anti joins: each
    split sends a value at most once, and null equals null.
    """
    sides = left.toDF("value").withColumn("_right", F.lit(False)).unionByName(
        right.toDF("value").withColumn("_right", F.lit(True))
    )
    found = sides.groupBy("value").agg(
        F.bool_and("_right").alias("_only_right"), F.bool_or("_right").alias("_any_right")
    )
    return found.where(F.col("_only_right") | ~F.col("_any_right")).select(
        "value", F.when(F.col("_only_right"), right_name).otherwise(left_name).alias("only_in")
    )
