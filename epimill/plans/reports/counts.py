"""Aggregations, filters, joins and sorted reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from epimill.functions.dates import days_after, days_before, parse_iso_date
from epimill.functions.texts import contains_any, first_part, last_part
from epimill.operators.groups import distinct_values, duplicate_keys, only_in_one, options, row_count, sum_by
from epimill.operators.joins import add_lookup, having_match, merge_lookups, without_match
from epimill.operators.metrics import area_classes
from epimill.operators.series import last_row
from epimill.operators.shape import area_level, drop_null, first_rows, keep_members, last_rows
from epimill.plans.analogue import daily_activity, read, tables
from epimill.plans.dashboard import LOOKUP_COLUMNS, combine, country_days
from epimill.plans.reports.registry import report

COUNTRY_DAYS = """
country_days AS (
  SELECT date_string, country_region, CAST(sum(confirmed) AS BIGINT) AS country_confirmed,
         CAST(sum(deaths) AS BIGINT) AS country_death
  FROM daily_case WHERE country_region IS NOT NULL GROUP BY 1, 2)
"""
LOOKUP = """
lookup AS (
  SELECT country_region, location, population, continent FROM country_loc
  WHERE coalesce(province_state, '') = '')
"""
COMBINED = (
    COUNTRY_DAYS.strip()
    + ", "
    + LOOKUP.strip()
    + """,
combined AS (
  SELECT date_string, country_region, country_confirmed, country_death, location, population, continent,
         vaccine, total_vaccinations, people_vaccinated, people_fully_vaccinated
  FROM country_days LEFT JOIN lookup USING (country_region) LEFT JOIN vac USING (location, date_string))
"""
)
TWO_SUMS = {"country_confirmed": "confirmed", "country_death": "deaths"}


@report("SELECT * FROM activity", tables=True)
def area_activity(spark, sf_dir):
    """The pass over the big tables behind all case and vaccination queries."""
    return daily_activity(spark, sf_dir)


@report("SELECT date_string, country_region, country_confirmed FROM country_days", COUNTRY_DAYS, True)
def country_daily_sum(spark, sf_dir):
    return country_days(tables(spark, sf_dir).daily_case)


@report("SELECT * FROM country_days", COUNTRY_DAYS, True)
def country_daily_two_sums(spark, sf_dir):
    return country_days(tables(spark, sf_dir).daily_case, TWO_SUMS)


@report(
    """SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority, count(*) AS n_orders,
              CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
       FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2 ORDER BY 1, 2"""
)
def filtered_sum_ordered(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderdate").cast("date").alias("day"),
        "o_orderpriority",
        F.lit(1).alias("one"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price_cents"),
    )
    return sum_by(rows, ["day", "o_orderpriority"], {"n_orders": "one", "cents": "price_cents"}).orderBy(
        "day", "o_orderpriority"
    )


@report(
    """SELECT date_string, country_region, CAST(sum(confirmed) AS BIGINT) AS country_confirmed
       FROM daily_case WHERE province_state IS NULL GROUP BY 1, 2""",
    tables=True,
)
def null_province_sum(spark, sf_dir):
    rows = tables(spark, sf_dir).daily_case.where(F.col("province_state").isNull())
    return country_days(rows)


@report(
    """SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders
       WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'
         AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-04-20' AND DATE '1999-04-30'
         AND o_totalprice >= 1000"""
)
def filter_predicates(spark, sf_dir):
    first, after_last = F.expr("timestamp_ntz'1996-04-20'"), F.expr("timestamp_ntz'1999-05-01'")
    return (
        read(spark, sf_dir, "orders")
        .where(
            (F.col("o_orderstatus") != "P")
            & (F.col("o_orderpriority") == "1-URGENT")
            & (F.col("o_orderdate") >= first)
            & (F.col("o_orderdate") < after_last)
            & (F.col("o_totalprice") >= 1000)
        )
        .select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    )


@report(
    """SELECT nullif(country_region, 'NATION_7') AS country_region, CAST(sum(confirmed) AS BIGINT) AS confirmed
       FROM daily_case WHERE country_region <> 'NATION_7' GROUP BY 1""",
    tables=True,
)
def drop_null_country(spark, sf_dir):
    unknown = F.expr("nullif(country_region, 'NATION_7')")
    rows = tables(spark, sf_dir).daily_case.withColumn("country_region", unknown)
    return sum_by(drop_null(rows, "country_region"), ["country_region"], {"confirmed": "confirmed"})


@report("SELECT * FROM lookup", LOOKUP, True)
def country_level_rows(spark, sf_dir):
    return area_level(tables(spark, sf_dir).country_loc, "province_state", LOOKUP_COLUMNS)


@report(
    """SELECT location, date_string, total_vaccinations, people_vaccinated FROM vac
       WHERE total_vaccinations IS NOT NULL AND people_vaccinated IS NOT NULL""",
    tables=True,
)
def drop_null_rows(spark, sf_dir):
    rows = drop_null(tables(spark, sf_dir).vac, "total_vaccinations", "people_vaccinated")
    return rows.select("location", "date_string", "total_vaccinations", "people_vaccinated")


@report(
    "SELECT * FROM country_loc WHERE continent IN ('Asia', 'Europe') AND province_state IN ('MACHINERY', '')",
    tables=True,
)
def membership_filter(spark, sf_dir):
    rows = keep_members(tables(spark, sf_dir).country_loc, "continent", ["Asia", "Europe"])
    return keep_members(keep_members(rows, "province_state", ["MACHINERY", ""]), "country_region", "all")


@report(
    """SELECT coalesce(a.country_region, l.country_region) AS country_region, a.province_state, a.uid,
              l.location, l.n_suppliers
       FROM areas a FULL JOIN locations l ON a.country_region IS NOT DISTINCT FROM l.country_region""",
    """areas AS (
         SELECT CASE WHEN n_regionkey = 4 THEN 'area ' || n_name ELSE nullif(n_name, 'NATION_1') END AS country_region,
                c_mktsegment AS province_state, min(c_custkey) AS uid
         FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
       locations AS (
         SELECT CASE WHEN n_regionkey = 0 THEN 'place ' || n_name
                     ELSE nullif(nullif(n_name, 'NATION_1'), 'NATION_2') END AS country_region,
                lower(n_name) AS location, count(*) AS n_suppliers
         FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)""",
)
def lookup_full_outer(spark, sf_dir):
    nations = read(spark, sf_dir, "nation")
    areas = (
        read(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.expr("if(n_regionkey = 4, concat('area ', n_name), nullif(n_name, 'NATION_1'))").alias("country_region"),
            F.col("c_mktsegment").alias("province_state"),
        )
        .agg(F.min("c_custkey").alias("uid"))
    )
    locations = (
        read(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.expr(
                "if(n_regionkey = 0, concat('place ', n_name), nullif(nullif(n_name, 'NATION_1'), 'NATION_2'))"
            ).alias("country_region"),
            F.lower("n_name").alias("location"),
        )
        .agg(F.count("*").alias("n_suppliers"))
    )
    return merge_lookups(areas, locations, "country_region")


@report(
    """SELECT date_string, country_region, country_confirmed, location, population, continent
       FROM country_days LEFT JOIN lookup USING (country_region)""",
    COUNTRY_DAYS.strip() + "," + LOOKUP,
    True,
)
def case_lookup_left(spark, sf_dir):
    loaded = tables(spark, sf_dir)
    lookup = area_level(loaded.country_loc, "province_state", LOOKUP_COLUMNS)
    return add_lookup(country_days(loaded.daily_case), lookup, "country_region")


@report("SELECT * FROM combined", COMBINED, True)
def case_lookup_vac_left(spark, sf_dir):
    loaded = tables(spark, sf_dir)
    return combine(loaded.daily_case, loaded.vac, loaded.country_loc, TWO_SUMS)


@report(
    """SELECT date_string, country_region, country_confirmed FROM combined
       WHERE country_region IN (
         SELECT country_region FROM combined WHERE total_vaccinations IS NOT NULL
         GROUP BY 1 HAVING arg_max(people_vaccinated IS NOT NULL, date_string))""",
    COMBINED,
    True,
)
def rows_of_people_class(spark, sf_dir):
    loaded = tables(spark, sf_dir)
    rows = combine(loaded.daily_case, loaded.vac, loaded.country_loc)
    classes = area_classes(rows, "country_region", "date_string", "total_vaccinations", "people_vaccinated")
    kept = having_match(rows, classes.where("vac_class = 'people'"), "country_region")
    return kept.select("date_string", "country_region", "country_confirmed")


@report(
    """SELECT c_custkey, c_name FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"""
)
def rows_without_match(spark, sf_dir):
    filled = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return without_match(customers, filled.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@report("SELECT DISTINCT date_string FROM vac", tables=True)
def distinct_dates(spark, sf_dir):
    return distinct_values(tables(spark, sf_dir).vac, "date_string")


@report("SELECT DISTINCT province_state FROM daily_case WHERE province_state IS NOT NULL", tables=True)
def option_lists(spark, sf_dir):
    return options(tables(spark, sf_dir).daily_case, "province_state")


@report("SELECT count(*) AS n_rows FROM lineitem")
def table_row_count(spark, sf_dir):
    return row_count(read(spark, sf_dir, "lineitem"))


@report(
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
       GROUP BY 1, 2 HAVING count(*) > 1"""
)
def repeated_keys(spark, sf_dir):
    return duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@report(
    """SELECT date_string, country_region, country_confirmed FROM country_days
       ORDER BY date_string DESC, country_region DESC LIMIT 20""",
    COUNTRY_DAYS,
    True,
)
def last_n(spark, sf_dir):
    return last_rows(country_days(tables(spark, sf_dir).daily_case), 20, "date_string", "country_region")


@report(
    """SELECT date_string, country_region, country_confirmed FROM country_days
       ORDER BY country_region, date_string LIMIT 10""",
    COUNTRY_DAYS,
    True,
)
def first_n(spark, sf_dir):
    return first_rows(country_days(tables(spark, sf_dir).daily_case), 10, "country_region", "date_string")


@report(
    """SELECT country_region, date_string, total_vaccinations, people_vaccinated FROM combined
       WHERE total_vaccinations IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY country_region ORDER BY date_string DESC) = 1""",
    COMBINED,
    True,
)
def last_per_group(spark, sf_dir):
    loaded = tables(spark, sf_dir)
    rows = drop_null(combine(loaded.daily_case, loaded.vac, loaded.country_loc), "total_vaccinations")
    return last_row(rows, ["country_region"], "date_string").select(
        "country_region", "date_string", "total_vaccinations", "people_vaccinated"
    )


@report(
    """SELECT country_region, vaccine, date_string, country_confirmed FROM combined
       WHERE people_vaccinated IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY country_region, vaccine ORDER BY date_string DESC) = 1""",
    COMBINED,
    True,
)
def last_per_pair(spark, sf_dir):
    loaded = tables(spark, sf_dir)
    rows = drop_null(combine(loaded.daily_case, loaded.vac, loaded.country_loc), "people_vaccinated")
    return last_row(rows, ["country_region", "vaccine"], "date_string").select(
        "country_region", "vaccine", "date_string", "country_confirmed"
    )


@report(
    """SELECT coalesce(a.value, b.value) AS value,
              CASE WHEN b.value IS NULL THEN 'no total' ELSE 'no people' END AS only_in
       FROM (SELECT country_region AS value FROM combined GROUP BY 1
             HAVING count(total_vaccinations) = 0) a
       FULL JOIN (SELECT country_region AS value FROM combined GROUP BY 1
                  HAVING count(people_vaccinated) = 0) b ON a.value = b.value
       WHERE a.value IS NULL OR b.value IS NULL""",
    COMBINED,
    True,
)
def symmetric_diff(spark, sf_dir):
    loaded = tables(spark, sf_dir)
    rows = combine(loaded.daily_case, loaded.vac, loaded.country_loc)
    seen = rows.groupBy("country_region").agg(
        F.count("total_vaccinations").alias("totals"), F.count("people_vaccinated").alias("people")
    )
    no_total = seen.where("totals = 0").select("country_region")
    no_people = seen.where("people = 0").select("country_region")
    return only_in_one(no_total, no_people, "no total", "no people")


@report(
    """SELECT date_string, country_region, CAST(date_string AS DATE) AS day,
              CAST(CAST(date_string AS DATE) - INTERVAL 7 DAY AS DATE) AS week_before,
              CAST(CAST(date_string AS DATE) + INTERVAL 1 DAY AS DATE) AS next_day
       FROM country_days""",
    COUNTRY_DAYS,
    True,
)
def shifted_dates(spark, sf_dir):
    day = parse_iso_date(F.col("date_string"))
    return country_days(tables(spark, sf_dir).daily_case).select(
        "date_string",
        "country_region",
        day.alias("day"),
        days_before(day, 7).alias("week_before"),
        days_after(day, 1).alias("next_day"),
    )


@report(
    """SELECT p_partkey, split_part(p_type, ' ', 1) AS first_word, split_part(p_type, ' ', -1) AS last_word,
              contains(p_name, '1') OR contains(p_name, '7') AS has_digit
       FROM part"""
)
def text_parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        first_part(F.col("p_type"), " ").alias("first_word"),
        last_part(F.col("p_type"), " ").alias("last_word"),
        contains_any(F.col("p_name"), ["1", "7"]).alias("has_digit"),
    )
