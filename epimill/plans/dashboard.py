"""The core query and the tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from epimill.functions.dates import parse_iso_date
from epimill.operators.groups import options, sum_by
from epimill.operators.joins import add_lookup, add_second_fact, one_per_key
from epimill.operators.metrics import (
    adjusted_by_class,
    class_by_any,
    class_by_latest,
    per_100k,
    percent,
    usable_for_class,
)
from epimill.operators.series import delta, latest_rows, null_if_negative, rolling_mean
from epimill.operators.shape import ALL, area_level, drop_null, keep_members

# Marker colours by continent, and the columns behind each choice.
CONTINENT_COLOURS = {
    "Africa": "black",
    "Asia": "yellow",
    "Europe": "blue",
    "Oceania": "green",
    "North America": "red",
    "South America": "cyan",
}
X_COLUMNS = {
    "Percentage": "percent_adjusted_people_vaccinated",
    "Absolute": "adjusted_people_vaccinated",
}
Y_COLUMNS = {
    "Per 100K": "past_week_daily_cases_per_100k",
    "Absolute": "past_week_daily_cases",
}
LOOKUP_COLUMNS = ["country_region", "location", "population", "continent"]


def country_days(daily_case: DataFrame, sums: dict[str, str] | None = None) -> DataFrame:
    """Country totals per day; rows without a country are dropped before the shuffle."""
    known = drop_null(daily_case, "country_region")
    return sum_by(known, ["date_string", "country_region"], sums or {"country_confirmed": "confirmed"})


def combine(
    daily_case: DataFrame, vac: DataFrame, country_loc: DataFrame, sums: dict[str, str] | None = None
) -> DataFrame:
    """Country totals with population, continent and vaccination counts."""
    lookup = one_per_key(area_level(country_loc, "province_state", LOOKUP_COLUMNS), "country_region")
    placed = add_lookup(country_days(daily_case, sums), lookup, "country_region")
    return add_second_fact(placed, vac, ["location", "date_string"], "location")


def case_trend(combined: DataFrame, min_rows: int = 1, any_row: bool = False) -> DataFrame:
    """Daily cases, their past-week mean and the country's vaccination class.

    ``min_rows`` is the number of known days a mean needs; with ``any_row`` the class
    comes from any row of a country instead of its latest.
    """
    key = ["country_region"]
    rows = combined.withColumn("date", parse_iso_date(F.col("date_string")))
    rows = rows.withColumn("daily_country_confirmed", delta(F.col("country_confirmed"), key, "date"))
    rows = rows.withColumn("daily_country_confirmed", null_if_negative(F.col("daily_country_confirmed")))
    total, people = F.col("total_vaccinations"), F.col("people_vaccinated")
    return rows.withColumns(
        {
            "past_week_daily_cases": rolling_mean(
                F.col("daily_country_confirmed"), key, "date", min_rows=min_rows
            ),
            "vac_class": class_by_any(total, people, key)
            if any_row
            else class_by_latest(total, people, key, "date"),
        }
    )


def adjusted_series(combined: DataFrame, min_rows: int = 1, any_row: bool = False) -> DataFrame:
    """All rows with an adjusted vaccination count, with rates by population."""
    label, total, people = F.col("vac_class"), F.col("total_vaccinations"), F.col("people_vaccinated")
    rows = case_trend(combined, min_rows, any_row).where(usable_for_class(label, total, people))
    rows = rows.withColumn(
        "adjusted_people_vaccinated",
        adjusted_by_class(label, total, people, F.col("people_fully_vaccinated")),
    )
    return rows.withColumns(
        {
            "past_week_daily_cases_per_100k": per_100k(F.col("past_week_daily_cases"), F.col("population")),
            "percent_adjusted_people_vaccinated": percent(
                F.col("adjusted_people_vaccinated"), F.col("population")
            ),
        }
    )


def latest_status(series: DataFrame) -> DataFrame:
    return latest_rows(series, ["country_region"], "date")


def chart_columns(x_choice: str = "Percentage", y_choice: str = "Absolute") -> tuple[str, str]:
    """Metric columns for the percent / absolute and per-100k / absolute choices."""
    return (
        X_COLUMNS.get(x_choice, X_COLUMNS["Absolute"]),
        Y_COLUMNS.get(y_choice, Y_COLUMNS["Absolute"]),
    )


def chart_selection(
    by: str, countries: str | Sequence[str] | None, areas: str | Sequence[str] | None
) -> tuple[str | Sequence[str], str | Sequence[str]]:
    """Country and continent filters for a choice by continent or by country; the
    list that is not chosen by, and an empty country list, restrict nothing."""
    if by == "Continent":
        return ALL, areas if areas is not None else ALL
    return countries or ALL, ALL


def latest_chart(
    latest: DataFrame,
    x: str = X_COLUMNS["Percentage"],
    y: str = Y_COLUMNS["Absolute"],
    countries: str | Sequence[str] = ALL,
    continents: str | Sequence[str] = ALL,
) -> DataFrame:
    """One point per country, with the colour of its continent."""
    rows = keep_members(keep_members(latest, "country_region", countries), "continent", continents)
    colours = F.create_map(*[F.lit(text) for pair in CONTINENT_COLOURS.items() for text in pair])
    return drop_null(rows, "continent").select(
        "continent",
        "country_region",
        "date_string",
        F.col(x).alias("x"),
        F.col(y).alias("y"),
        F.try_element_at(colours, F.col("continent")).alias("colour"),
    )


def series_chart(
    series: DataFrame,
    countries: str | Sequence[str],
    x: str = X_COLUMNS["Percentage"],
    y: str = Y_COLUMNS["Absolute"],
) -> DataFrame:
    """Points over time for chosen countries, by country and date."""
    chosen = [countries] if isinstance(countries, str) else list(countries)
    return (
        keep_members(series, "country_region", chosen)
        .select("country_region", "date_string", F.col(x).alias("x"), F.col(y).alias("y"))
        .orderBy("country_region", "date_string")
    )


def countries_in(latest: DataFrame, continents: Sequence[str]) -> DataFrame:
    return keep_members(latest, "continent", continents).select("country_region").distinct()


def countries_with_total(combined: DataFrame) -> DataFrame:
    return options(drop_null(combined, "total_vaccinations"), "country_region")


def continents(combined: DataFrame) -> DataFrame:
    return options(combined, "continent")
