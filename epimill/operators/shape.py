"""Filters, projections, cleaning and de-duplication."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from epimill.functions.numbers import nan_to_null, whole_number
from epimill.functions.texts import is_blank, splice
from epimill.session import local_table

ALL = "all"

# Reports whose update stamp carries the wrong day.
STAMP_CORRECTIONS = (
    ("06-01-2021.csv", "Nebraska", "2021-06-01", "2021-06-02"),
    ("06-12-2021.csv", "Florida", "2021-06-12", "2021-06-13"),
)


def keep_members(df: DataFrame, column: str, values: str | Sequence) -> DataFrame:
    """Rows whose value is in the list; ``'all'`` keeps every row, nulls included."""
    if isinstance(values, str):
        return df if values == ALL else df.where(F.col(column) == values)
    return df.where(F.col(column).isin([value for value in dict.fromkeys(values) if value is not None]))


def drop_null(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or NaN, as plain pushable filters."""
    for name in columns:
        df = df.where(F.col(name).isNotNull())
        if df.schema[name].dataType.typeName() in ("double", "float"):
            df = df.where(~F.isnan(name))
    return df


def area_level(df: DataFrame, sub_area: str, keep: Sequence[str]) -> DataFrame:
    """Rows of whole areas: those whose sub-area is null or blank."""
    return df.where(is_blank(F.col(sub_area))).select(*keep)


def blank_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.fill("", list(keys))


def null_nans(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: nan_to_null(F.col(name)) for name in columns})


def whole_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: whole_number(F.col(name)) for name in columns})


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in the given order.

    Spark reduces each input split to one row per key before the shuffle, so a
    key that holds a large share of the rows does not fill one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def corrections_table(spark: SparkSession, corrections: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    corrections = list(corrections)
    if len({tuple(correction[:3]) for correction in corrections}) < len(corrections):
        raise ValueError("two corrections for one file, area and day")
    files, areas, old_days, new_days = (list(column) for column in zip(*corrections, strict=True))
    return local_table(spark, file=files, area=areas, old_day=old_days, new_day=new_days)


def correct_stamps(
    df: DataFrame,
    corrections: DataFrame,
    file: str = "source_file",
    area: str = "province_state",
    stamp: str = "last_update",
) -> DataFrame:
    """Swap the date part of a stamp for the (file, area, old day) keys in the table, which are unique."""
    fixes = corrections.select(
        F.col("file").alias(file),
        F.col("area").alias(area),
        F.col("old_day").alias("_old_day"),
        F.col("new_day").alias("_new_day"),
    )
    fixed = F.when(F.col("_new_day").isNotNull(), splice(F.col(stamp), 1, 10, F.col("_new_day"))).otherwise(F.col(stamp))
    return (
        df.withColumn("_old_day", F.substring(F.col(stamp), 1, 10))
        .join(fixes, [file, area, "_old_day"], "left")
        .withColumn(stamp, fixed)
        .select(*df.columns)
    )


def last_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n rows that come last in the given order, latest first."""
    return df.orderBy(*[F.col(name).desc() for name in order]).limit(n)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
