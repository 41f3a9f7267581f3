"""The core query: vaccination classes, adjusted counts, rates, latest status."""

from __future__ import annotations

from pyspark.sql import functions as F

from epimill.operators.metrics import adjusted_people, area_classes, area_classes_any, percent
from epimill.plans.analogue import tables
from epimill.plans.dashboard import adjusted_series, case_trend, combine, latest_status
from epimill.plans.reports.counts import COMBINED
from epimill.plans.reports.registry import report

BY_LATEST = """
classes AS (
  SELECT country_region,
         CASE WHEN arg_max(people_vaccinated IS NOT NULL, date_string) THEN 'people'
              ELSE 'total_only' END AS vac_class
  FROM combined WHERE total_vaccinations IS NOT NULL GROUP BY 1)
"""
BY_ANY = """
classes AS (
  SELECT country_region, CASE WHEN count(people_vaccinated) > 0 THEN 'people' ELSE 'total_only' END AS vac_class
  FROM combined GROUP BY 1 HAVING count(people_vaccinated) > 0 OR count(total_vaccinations) > 0)
"""
AFTER_CLASSES = """
raw_delta AS (
  SELECT *, coalesce(country_confirmed - lag(country_confirmed)
                     OVER (PARTITION BY country_region ORDER BY date_string), 0) AS change
  FROM combined),
trend AS (
  SELECT *, CAST(sum(daily) OVER w AS DOUBLE) / nullif(count(daily) OVER w, 0) AS past_week_daily_cases,
         count(daily) OVER w AS n_days
  FROM (SELECT *, CASE WHEN change >= 0 THEN change END AS daily FROM raw_delta)
       LEFT JOIN classes USING (country_region)
  WINDOW w AS (PARTITION BY country_region ORDER BY date_string ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
counted AS (
  SELECT *, CASE vac_class
              WHEN 'people' THEN coalesce(people_fully_vaccinated, 0)
                   + 0.5::DOUBLE * (coalesce(people_vaccinated, 0) - coalesce(people_fully_vaccinated, 0))
              WHEN 'total_only' THEN 0.5::DOUBLE * coalesce(total_vaccinations, 0)
            END AS adjusted_people_vaccinated
  FROM trend
  WHERE (vac_class = 'people' AND people_vaccinated IS NOT NULL)
     OR (vac_class = 'total_only' AND total_vaccinations IS NOT NULL)),
adjusted AS (
  SELECT *, past_week_daily_cases / nullif(population, 0) * 100000 AS past_week_daily_cases_per_100k,
         adjusted_people_vaccinated / nullif(population, 0) * 100 AS percent_adjusted_people_vaccinated
  FROM counted)
"""
TREND = ", ".join(part.strip() for part in (COMBINED, BY_LATEST, AFTER_CLASSES))
TREND_BY_ANY = ", ".join(part.strip() for part in (COMBINED, BY_ANY, AFTER_CLASSES))
STATUS = [
    "country_region",
    "date_string",
    "continent",
    "population",
    "country_confirmed",
    "daily_country_confirmed",
    "past_week_daily_cases",
    "past_week_daily_cases_per_100k",
    "adjusted_people_vaccinated",
    "percent_adjusted_people_vaccinated",
    "vac_class",
]
STATUS_SQL = ", ".join(
    "daily AS daily_country_confirmed" if name == "daily_country_confirmed" else name for name in STATUS
)
LATEST = "SELECT * FROM adjusted QUALIFY date_string = max(date_string) OVER (PARTITION BY country_region)"


def combined(spark, sf_dir):
    loaded = tables(spark, sf_dir)
    return combine(loaded.daily_case, loaded.vac, loaded.country_loc)


@report(f"SELECT {STATUS_SQL} FROM ({LATEST})", TREND, True)
def latest_snapshot(spark, sf_dir):
    return latest_status(adjusted_series(combined(spark, sf_dir))).select(*STATUS)


@report(f"SELECT {STATUS_SQL} FROM adjusted", TREND, True)
def adjusted_vaccinated(spark, sf_dir):
    return adjusted_series(combined(spark, sf_dir)).select(*STATUS)


@report("SELECT * FROM classes", TREND, True)
def country_class(spark, sf_dir):
    return area_classes(
        combined(spark, sf_dir), "country_region", "date_string", "total_vaccinations", "people_vaccinated"
    )


@report(
    "SELECT DISTINCT country_region, vac_class FROM trend WHERE vac_class IS NOT NULL", TREND, True
)
def country_class_in_trend(spark, sf_dir):
    rows = case_trend(combined(spark, sf_dir)).where("vac_class is not null")
    return rows.select("country_region", "vac_class").distinct()


@report(
    """SELECT country_region, CASE WHEN count(people_vaccinated) > 0 THEN 'people' ELSE 'total_only' END AS vac_class
       FROM combined GROUP BY 1 HAVING count(people_vaccinated) > 0 OR count(total_vaccinations) > 0""",
    COMBINED,
    True,
)
def country_class_any(spark, sf_dir):
    return area_classes_any(
        combined(spark, sf_dir), "country_region", "total_vaccinations", "people_vaccinated"
    )


@report(
    """SELECT date_string, country_region,
              people_fully_vaccinated + 0.5::DOUBLE * (people_vaccinated - people_fully_vaccinated)
                AS adjusted_people_vaccinated
       FROM combined""",
    COMBINED,
    True,
)
def adjusted_or_null(spark, sf_dir):
    adjusted = adjusted_people(F.col("people_vaccinated"), F.col("people_fully_vaccinated"))
    return combined(spark, sf_dir).select(
        "date_string", "country_region", adjusted.alias("adjusted_people_vaccinated")
    )


@report(
    """SELECT date_string, country_region,
              CAST(people_vaccinated AS DOUBLE) / nullif(population, 0) * 100 AS percent_people_vaccinated,
              CAST(total_vaccinations AS DOUBLE) / nullif(population, 0) * 100 AS percent_total_vaccinations
       FROM combined""",
    COMBINED,
    True,
)
def percent_vaccinated(spark, sf_dir):
    population = F.col("population")
    return combined(spark, sf_dir).select(
        "date_string",
        "country_region",
        percent(F.col("people_vaccinated"), population).alias("percent_people_vaccinated"),
        percent(F.col("total_vaccinations"), population).alias("percent_total_vaccinations"),
    )


@report(
    """SELECT date_string, country_region, past_week_daily_cases, past_week_daily_cases_per_100k
       FROM adjusted""",
    TREND,
    True,
)
def per_100k_rates(spark, sf_dir):
    return adjusted_series(combined(spark, sf_dir)).select(
        "date_string", "country_region", "past_week_daily_cases", "past_week_daily_cases_per_100k"
    )


@report(
    """SELECT country_region, date_string, vac_class,
              CASE WHEN n_days >= 7 THEN past_week_daily_cases END AS past_week_daily_cases,
              percent_adjusted_people_vaccinated
       FROM adjusted QUALIFY date_string = max(date_string) OVER (PARTITION BY country_region)""",
    TREND_BY_ANY,
    True,
)
def latest_snapshot_any_class(spark, sf_dir):
    """The older snapshot: classes from any row, means only from seven known days."""
    series = adjusted_series(combined(spark, sf_dir), min_rows=7, any_row=True)
    return latest_status(series).select(
        "country_region", "date_string", "vac_class", "past_week_daily_cases", "percent_adjusted_people_vaccinated"
    )
