"""Per-country series: deltas, rolling and weighted means, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from epimill.functions.numbers import log10_positive
from epimill.operators.series import null_if_negative, rolling_mean
from epimill.plans.analogue import tables
from epimill.plans.dashboard import combine, country_days
from epimill.plans.reports.counts import COUNTRY_DAYS, TWO_SUMS
from epimill.plans.reports.registry import report
from epimill.plans.trends import KEY, country_trend, daily_counts, smoothed, weekly_rates, without_outliers

# Our choice: daily counts of the provided tables are small, so the outlier rule
# gets a lower threshold than its default.
OUTLIER_THRESHOLD = 20.0

DELTAS = (
    COUNTRY_DAYS.strip()
    + """,
deltas AS (
  SELECT *,
         coalesce(country_confirmed - lag(country_confirmed) OVER w, 0) AS daily_cases,
         coalesce(country_death - lag(country_death) OVER w, 0) AS daily_deaths
  FROM country_days WINDOW w AS (PARTITION BY country_region ORDER BY date_string)),
clean AS (
  SELECT *, CASE WHEN daily_cases >= 0 THEN daily_cases END AS daily_or_null FROM deltas)
"""
)
# The weighted mean in closed form: sums of value / keep^row scaled back by keep^row.
SMOOTH = (
    DELTAS.strip()
    + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY country_region ORDER BY date_string) - 1 AS n FROM deltas),
smooth AS (
  SELECT *,
         sum(daily_cases * pow(0.8, -n)) OVER w / sum(pow(0.8, -n)) OVER w AS smooth_cases,
         sum(daily_deaths * pow(0.8, -n)) OVER w / sum(pow(0.8, -n)) OVER w AS smooth_deaths
  FROM numbered WINDOW w AS (PARTITION BY country_region ORDER BY date_string))
"""
)


def daily_deltas(spark, sf_dir):
    return daily_counts(country_days(tables(spark, sf_dir).daily_case, TWO_SUMS))


@report("SELECT date_string, country_region, daily_cases, daily_deaths FROM deltas", DELTAS, True)
def daily_delta(spark, sf_dir):
    return daily_deltas(spark, sf_dir).select("date_string", "country_region", "daily_cases", "daily_deaths")


@report("SELECT date_string, country_region, daily_or_null FROM clean", DELTAS, True)
def nonneg_delta(spark, sf_dir):
    return daily_deltas(spark, sf_dir).select(
        "date_string", "country_region", null_if_negative(F.col("daily_cases")).alias("daily_or_null")
    )


@report(
    """SELECT date_string, country_region,
              CAST(sum(daily_or_null) OVER w AS DOUBLE) / nullif(count(daily_or_null) OVER w, 0)
                AS past_week_daily_cases
       FROM clean
       WINDOW w AS (PARTITION BY country_region ORDER BY date_string ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    DELTAS,
    True,
)
def rolling7_min1(spark, sf_dir):
    rows = daily_deltas(spark, sf_dir)
    rows = rows.withColumn("daily_or_null", null_if_negative(F.col("daily_cases")))
    mean = rolling_mean(F.col("daily_or_null"), KEY, "date_string", 7, 1)
    return rows.select("date_string", "country_region", mean.alias("past_week_daily_cases"))


@report(
    """SELECT date_string, country_region,
              CASE WHEN count(daily_or_null) OVER w >= 7
                   THEN CAST(sum(daily_or_null) OVER w AS DOUBLE) / count(daily_or_null) OVER w END
                AS past_week_daily_cases
       FROM clean
       WINDOW w AS (PARTITION BY country_region ORDER BY date_string ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    DELTAS,
    True,
)
def rolling7_min7(spark, sf_dir):
    rows = daily_deltas(spark, sf_dir)
    rows = rows.withColumn("daily_or_null", null_if_negative(F.col("daily_cases")))
    mean = rolling_mean(F.col("daily_or_null"), KEY, "date_string", 7, 7)
    return rows.select("date_string", "country_region", mean.alias("past_week_daily_cases"))


@report(
    """SELECT date_string, country_region, round(smooth_cases, 6) AS smooth_cases,
              round(smooth_deaths, 6) AS smooth_deaths FROM smooth""",
    SMOOTH,
    True,
)
def ewm_means(spark, sf_dir):
    return smoothed(daily_deltas(spark, sf_dir)).select(
        "date_string",
        "country_region",
        F.round("smooth_cases", 6).alias("smooth_cases"),
        F.round("smooth_deaths", 6).alias("smooth_deaths"),
    )


@report(
    """SELECT date_string, country_region, daily_cases, daily_deaths FROM smooth
       WHERE NOT (abs(daily_cases) > abs(smooth_cases * 2) AND abs(daily_cases) > 20)
         AND NOT (abs(daily_deaths) > abs(smooth_deaths * 2) AND abs(daily_deaths) > 20)""",
    SMOOTH,
    True,
)
def outlier_drop(spark, sf_dir):
    kept = without_outliers(daily_deltas(spark, sf_dir), threshold=OUTLIER_THRESHOLD)
    return kept.select("date_string", "country_region", "daily_cases", "daily_deaths")


@report(
    """SELECT date_string, country_region, past_week_deaths,
              past_week_deaths / nullif(population, 0) * 100000 AS past_week_deaths_per_100k,
              past_week_deaths / nullif(past_week_cases, 0) AS deaths_over_cases
       FROM (
         SELECT date_string, country_region, population,
                CASE WHEN count(*) OVER w >= 7
                     THEN CAST(sum(daily_deaths) OVER w AS DOUBLE) / count(*) OVER w END AS past_week_deaths,
                CASE WHEN count(*) OVER w >= 7
                     THEN CAST(sum(daily_cases) OVER w AS DOUBLE) / count(*) OVER w END AS past_week_cases
         FROM deltas JOIN lookup USING (country_region)
         WINDOW w AS (PARTITION BY country_region ORDER BY date_string
                      ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""",
    DELTAS.strip()
    + """, lookup AS (SELECT country_region, population FROM country_loc
                      WHERE coalesce(province_state, '') = '')""",
    True,
)
def death_case_ratio(spark, sf_dir):
    loaded = tables(spark, sf_dir)
    rows = combine(loaded.daily_case, loaded.vac, loaded.country_loc, TWO_SUMS)
    return weekly_rates(daily_counts(rows)).select(
        "date_string", "country_region", "past_week_deaths", "past_week_deaths_per_100k", "deaths_over_cases"
    )


@report(
    """SELECT date_string, country_region, daily_cases, daily_deaths, past_week_cases, past_week_deaths,
              past_week_cases / nullif(population, 0) * 100000 AS past_week_cases_per_100k,
              past_week_deaths / nullif(past_week_cases, 0) AS deaths_over_cases,
              (people_fully_vaccinated + 0.5::DOUBLE * (people_vaccinated - people_fully_vaccinated))
                / nullif(population, 0) * 100 AS percent_adjusted_people_vaccinated
       FROM (
         SELECT *,
                CASE WHEN count(*) OVER w >= 7
                     THEN CAST(sum(daily_deaths) OVER w AS DOUBLE) / count(*) OVER w END AS past_week_deaths,
                CASE WHEN count(*) OVER w >= 7
                     THEN CAST(sum(daily_cases) OVER w AS DOUBLE) / count(*) OVER w END AS past_week_cases
         FROM kept
         WINDOW w AS (PARTITION BY country_region ORDER BY date_string
                      ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""",
    SMOOTH.strip()
    + """,
kept AS (
  SELECT smooth.*, population, people_vaccinated, people_fully_vaccinated
  FROM smooth
  JOIN (SELECT country_region, location, population FROM country_loc
        WHERE coalesce(province_state, '') = '') USING (country_region)
  LEFT JOIN vac USING (location, date_string)
  WHERE NOT (abs(daily_cases) > abs(smooth_cases * 2) AND abs(daily_cases) > 20)
    AND NOT (abs(daily_deaths) > abs(smooth_deaths * 2) AND abs(daily_deaths) > 20))""",
    True,
)
def outlier_free_trend(spark, sf_dir):
    loaded = tables(spark, sf_dir)
    rows = combine(loaded.daily_case, loaded.vac, loaded.country_loc, TWO_SUMS)
    return country_trend(rows, OUTLIER_THRESHOLD).select(
        "date_string",
        "country_region",
        "daily_cases",
        "daily_deaths",
        "past_week_cases",
        "past_week_deaths",
        "past_week_cases_per_100k",
        "deaths_over_cases",
        "percent_adjusted_people_vaccinated",
    )


@report(
    """SELECT date_string, country_region,
              round(CASE WHEN country_confirmed > 0 THEN log10(country_confirmed) END, 6) AS log_confirmed,
              round(CASE WHEN country_death > 0 THEN log10(country_death) END, 6) AS log_deaths
       FROM country_days""",
    COUNTRY_DAYS,
    True,
)
def log_cases(spark, sf_dir):
    return country_days(tables(spark, sf_dir).daily_case, TWO_SUMS).select(
        "date_string",
        "country_region",
        F.round(log10_positive(F.col("country_confirmed")), 6).alias("log_confirmed"),
        F.round(log10_positive(F.col("country_death")), 6).alias("log_deaths"),
    )


