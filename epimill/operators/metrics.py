"""Vaccination and case metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from epimill.functions.numbers import ratio, zero_if_null

PEOPLE = "people"
TOTAL_ONLY = "total_only"


def row_state(people: Column, order: str) -> Column:
    """Date, whether people are counted, and the class that follows; compares by date."""
    counted = people.isNotNull()
    label = F.when(counted, PEOPLE).otherwise(TOTAL_ONLY)
    return F.struct(F.col(order).alias("day"), counted.alias("counted"), label.alias("label"))


def class_by_latest(total: Column, people: Column, keys: Sequence[str], order: str) -> Column:
    """Class of an area from its latest row that has a total.

    ``people`` if that row also counts people, ``total_only`` if not, null for an
    area without any total. Shares the shuffle of other windows over the keys.
    """
    state = F.when(total.isNotNull(), row_state(people, order))
    return F.max(state).over(Window.partitionBy(*keys))["label"]


def class_by_any(total: Column, people: Column, keys: Sequence[str]) -> Column:
    """Older rule: ``people`` if any row counts people, ``total_only`` if only totals exist."""
    area = Window.partitionBy(*keys)
    has_total = F.count(total).over(area) > 0
    return F.when(F.count(people).over(area) > 0, PEOPLE).when(has_total, TOTAL_ONLY)


def area_classes(df: DataFrame, key: str, order: str, total: str, people: str) -> DataFrame:
    """One row per classified area, by the same rule as ``class_by_latest``.

    A plain aggregate, so that each split sends one row per area.
    """
    latest = F.max(row_state(F.col(people), order))["label"]
    return df.where(F.col(total).isNotNull()).groupBy(key).agg(latest.alias("vac_class"))


def area_classes_any(df: DataFrame, key: str, total: str, people: str) -> DataFrame:
    """Class of an area from any of its rows: people if one counts people."""
    seen = df.groupBy(key).agg(
        F.bool_or(F.col(total).isNotNull()).alias("has_total"),
        F.bool_or(F.col(people).isNotNull()).alias("has_people"),
    )
    label = F.when(F.col("has_people"), PEOPLE).when(F.col("has_total"), TOTAL_ONLY)
    return seen.select(key, label.alias("vac_class")).where(F.col("vac_class").isNotNull())


def adjusted_people(people: Column, fully: Column) -> Column:
    """Full doses count one person, first doses half; null if either count is."""
    return fully + 0.5 * (people - fully)


def adjusted_by_class(vac_class: Column, total: Column, people: Column, fully: Column) -> Column:
    """Adjusted count by class: nulls count as 0, half of all doses for total-only."""
    counted = adjusted_people(zero_if_null(people), zero_if_null(fully))
    return F.when(vac_class == PEOPLE, counted).when(vac_class == TOTAL_ONLY, 0.5 * zero_if_null(total))


def usable_for_class(vac_class: Column, total: Column, people: Column) -> Column:
    """Rows that hold the count their class is computed from."""
    return F.coalesce(
        F.when(vac_class == PEOPLE, people.isNotNull()).when(vac_class == TOTAL_ONLY, total.isNotNull()),
        F.lit(False),
    )


def per_100k(value: Column, population: Column) -> Column:
    return ratio(value, population, 100000)


def percent(value: Column, population: Column) -> Column:
    return ratio(value, population, 100)
