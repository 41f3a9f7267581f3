"""The tables behind the charts and their drop-down lists."""

from __future__ import annotations

from epimill.plans.dashboard import (
    adjusted_series,
    chart_columns,
    continents,
    countries_in,
    countries_with_total,
    latest_chart,
    latest_status,
    series_chart,
)
from epimill.plans.reports.counts import COMBINED
from epimill.plans.reports.registry import report
from epimill.plans.reports.vaccination import LATEST, TREND, combined

POINT_COLOUR = """CASE continent WHEN 'Africa' THEN 'black' WHEN 'Asia' THEN 'yellow'
                                 WHEN 'Europe' THEN 'blue' END AS colour"""


def latest(spark, sf_dir):
    return latest_status(adjusted_series(combined(spark, sf_dir)))


@report(
    f"""SELECT continent, country_region, date_string, percent_adjusted_people_vaccinated AS x,
              past_week_daily_cases AS y, {POINT_COLOUR}
       FROM ({LATEST}) WHERE continent IS NOT NULL""",
    TREND,
    True,
)
def chart_latest(spark, sf_dir):
    return latest_chart(latest(spark, sf_dir))


@report(
    f"""SELECT continent, country_region, date_string, adjusted_people_vaccinated AS x,
              past_week_daily_cases_per_100k AS y, {POINT_COLOUR}
       FROM ({LATEST}) WHERE continent IN ('Asia', 'Europe')""",
    TREND,
    True,
)
def chart_latest_by_continent(spark, sf_dir):
    x, y = chart_columns("Absolute", "Per 100K")
    return latest_chart(latest(spark, sf_dir), x, y, continents=["Asia", "Europe"])


@report(
    """SELECT country_region, date_string, percent_adjusted_people_vaccinated AS x, past_week_daily_cases AS y
       FROM adjusted WHERE country_region IN ('NATION_2', 'NATION_5', 'NATION_9') ORDER BY 1, 2""",
    TREND,
    True,
)
def chart_series(spark, sf_dir):
    series = adjusted_series(combined(spark, sf_dir))
    return series_chart(series, ["NATION_2", "NATION_5", "NATION_9"])


@report(
    f"SELECT DISTINCT country_region FROM ({LATEST}) WHERE continent IN ('Africa', 'America')", TREND, True
)
def countries_in_continents(spark, sf_dir):
    return countries_in(latest(spark, sf_dir), ["Africa", "America"])


@report("SELECT DISTINCT country_region FROM combined WHERE total_vaccinations IS NOT NULL", COMBINED, True)
def country_options(spark, sf_dir):
    return countries_with_total(combined(spark, sf_dir))


@report("SELECT DISTINCT continent FROM combined WHERE continent IS NOT NULL", COMBINED, True)
def continent_options(spark, sf_dir):
    return continents(combined(spark, sf_dir))
