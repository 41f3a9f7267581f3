"""Trends of cases, deaths and vaccination per country, with outliers removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from epimill.functions.numbers import ratio
from epimill.operators.metrics import adjusted_people, per_100k, percent
from epimill.operators.series import add_ewm_means, delta, drop_outliers, rolling_mean

KEY = ["country_region"]
# Smoothing factor of the weighted mean, and the outlier rule.
ALPHA = 0.2
OUTLIER_FACTOR = 2.0
OUTLIER_THRESHOLD = 10000.0


def daily_counts(totals: DataFrame, order: str = "date_string", keys: Sequence[str] = KEY) -> DataFrame:
    """Daily cases and deaths from cumulative country totals."""
    return totals.withColumns(
        {
            "daily_cases": delta(F.col("country_confirmed"), keys, order),
            "daily_deaths": delta(F.col("country_death"), keys, order),
        }
    )


def smoothed(daily: DataFrame, order: str = "date_string", keys: Sequence[str] = KEY) -> DataFrame:
    means = {"smooth_cases": "daily_cases", "smooth_deaths": "daily_deaths"}
    return add_ewm_means(daily, means, keys, order, ALPHA)


def without_outliers(
    daily: DataFrame,
    checks: Sequence[tuple[str, str]] = (("daily_cases", "smooth_cases"), ("daily_deaths", "smooth_deaths")),
    factor: float = OUTLIER_FACTOR,
    threshold: float = OUTLIER_THRESHOLD,
) -> DataFrame:
    """Daily counts without the days that stand out in any of the checked counts."""
    return drop_outliers(smoothed(daily), checks, factor, threshold)


def weekly_rates(daily: DataFrame, order: str = "date_string", keys: Sequence[str] = KEY) -> DataFrame:
    """Past-week means, their rates by population, and vaccination percentages.

    Means need seven rows; an adjusted count with a missing part is null.
    """
    population = F.col("population")
    rows = daily.withColumns(
        {
            "past_week_cases": rolling_mean(F.col("daily_cases"), keys, order, 7, 7),
            "past_week_deaths": rolling_mean(F.col("daily_deaths"), keys, order, 7, 7),
            "adjusted_people_vaccinated": adjusted_people(
                F.col("people_vaccinated"), F.col("people_fully_vaccinated")
            ),
        }
    )
    return rows.withColumns(
        {
            "past_week_cases_per_100k": per_100k(F.col("past_week_cases"), population),
            "past_week_deaths_per_100k": per_100k(F.col("past_week_deaths"), population),
            "deaths_over_cases": ratio(F.col("past_week_deaths"), F.col("past_week_cases")),
            "percent_people_vaccinated": percent(F.col("people_vaccinated"), population),
            "percent_total_vaccinations": percent(F.col("total_vaccinations"), population),
            "percent_adjusted_people_vaccinated": percent(F.col("adjusted_people_vaccinated"), population),
        }
    )


def country_trend(combined: DataFrame, threshold: float = OUTLIER_THRESHOLD) -> DataFrame:
    """The whole chain over combined rows with case and death totals."""
    return weekly_rates(without_outliers(daily_counts(combined), threshold=threshold))
