"""Data-quality checks over lookups, vaccinations and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from epimill.operators.joins import add_lookup
from epimill.plans.analogue import read, tables
from epimill.plans.quality import (
    check_areas,
    check_fan_out,
    check_files,
    check_keys,
    check_locations,
    check_unreadable,
    check_vaccinations,
)
from epimill.plans.reports.registry import report

SUPPLIED = """
areas AS (
  SELECT n_name AS country_region, c_mktsegment AS province_state FROM customer
  JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT s_name, NULL FROM supplier)
"""


def areas(spark, sf_dir):
    """Nations with their segments, and supplier names that no case table holds."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    known = add_lookup(read(spark, sf_dir, "customer"), nations, "c_nationkey").select(
        F.col("n_name").alias("country_region"), F.col("c_mktsegment").alias("province_state")
    )
    unknown = read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("country_region"), F.lit(None).cast("string").alias("province_state")
    )
    return known.unionByName(unknown)


def gap(check: str, column: str, table: str, table_column: str, name: str, source: str = "areas") -> str:
    return f"""SELECT '{check}' AS "check", 'not in {name}' AS direction, {column} AS value
      FROM (SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL) s
      WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE t.{table_column} = s.{column})"""


@report(
    gap("countries", "country_region", "daily_case", "country_region", "daily_case")
    + " UNION ALL "
    + gap("provinces", "province_state", "daily_case", "province_state", "daily_case"),
    SUPPLIED,
    True,
)
def lookup_gaps(spark, sf_dir):
    return check_areas(areas(spark, sf_dir), tables(spark, sf_dir).daily_case, "daily_case")


@report(
    gap("countries", "country_region", "country_loc", "country_region", "country_loc")
    + " UNION ALL "
    + gap("provinces", "province_state", "country_loc", "province_state", "country_loc"),
    SUPPLIED,
    True,
)
def country_loc_gaps(spark, sf_dir):
    return check_areas(areas(spark, sf_dir), tables(spark, sf_dir).country_loc, "country_loc")


@report(
    gap("locations", "location", "country_loc", "location", "country_loc", "locations"),
    "locations AS (SELECT lower(n_name) AS location FROM nation UNION SELECT lower(s_name) FROM supplier)",
    True,
)
def location_gaps(spark, sf_dir):
    names = read(spark, sf_dir, "nation").select(F.lower("n_name").alias("location"))
    more = read(spark, sf_dir, "supplier").select(F.lower("s_name").alias("location"))
    return check_locations(names.unionByName(more), tables(spark, sf_dir).country_loc)


TOTALS = """
totals AS (
  SELECT DISTINCT lower(n_name) AS location, strftime(l_shipdate, '%Y-%m-%d') AS date
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT lower(r_name), '1994-01-0' || (r_regionkey + 1) FROM region),
vac_files AS (
  SELECT CASE WHEN n_regionkey = 2 THEN 'old ' ELSE '' END || lower(n_name) || '.csv' AS file_name FROM nation)
"""


@report(
    gap("locations", "location", "vac", "location", "vac", "totals")
    + " UNION ALL "
    + gap(
        "locations",
        "location",
        "(SELECT split_part(file_name, '.', 1) AS location FROM vac_files)",
        "location",
        "csv_record",
        "totals",
    )
    + " UNION ALL "
    + gap("dates", "date", "vac", "date_string", "vac", "totals"),
    TOTALS,
    True,
)
def vaccination_gaps(spark, sf_dir):
    nations = read(spark, sf_dir, "nation")
    shipped = read(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")
    )
    totals = (
        shipped.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.lower("n_name").alias("location"), "date")
    )
    regions = read(spark, sf_dir, "region").select(
        F.lower("r_name").alias("location"),
        F.concat(F.lit("1994-01-0"), (F.col("r_regionkey") + 1).cast("string")).alias("date"),
    )
    prefix = F.when(F.col("n_regionkey") == 2, "old ").otherwise("")
    ledger = nations.select(
        F.concat(prefix, F.lower("n_name"), F.lit(".csv")).alias("file_name"), F.lit("vac").alias("data_type")
    )
    return check_vaccinations(totals.unionByName(regions), tables(spark, sf_dir).vac, ledger)


@report(
    """SELECT 'vac files' AS "check", 'only in files' AS direction, s_name || '.csv' AS value FROM supplier
       WHERE s_acctbal < 0
       UNION ALL SELECT 'vac files', 'only in csv_record', n_name || '.csv' FROM nation"""
)
def vaccination_file_gaps(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier")
    name = F.concat("s_name", F.lit(".csv")).alias("file_name")
    files = suppliers.select(name)
    kept = suppliers.where("s_acctbal >= 0").select(name)
    gone = read(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".csv")).alias("file_name"))
    ledger = kept.unionByName(gone).withColumn("data_type", F.lit("vac"))
    return check_files(files, ledger, "vac")


@report(
    """SELECT DISTINCT 'unreadable count' AS "check", 'total' AS direction, o_orderkey || ',5' AS value
       FROM orders WHERE o_orderpriority = '1-URGENT'
       UNION ALL SELECT DISTINCT 'unreadable count', 'status', o_orderstatus FROM orders
       WHERE o_orderpriority = '2-HIGH'"""
)
def unreadable_counts(spark, sf_dir):
    """Totals with a comma and letters among the numbers; blank and null texts are no finding."""
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    texts = read(spark, sf_dir, "orders").select(
        F.when(urgent, F.concat(F.col("o_orderkey").cast("string"), F.lit(",5")))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("total"),
        F.when(high, F.col("o_orderstatus")).when(urgent, F.lit(" ")).alias("status"),
    )
    return check_unreadable(texts, ["total", "status"])


@report(
    """SELECT 'unique key' AS "check", 'lineitem' AS direction,
              CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS value
       FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
)
def duplicate_key_report(spark, sf_dir):
    return check_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")


@report(
    """SELECT 'unique key' AS "check", 'country_loc country level' AS direction, country_region AS value
       FROM (SELECT country_region, coalesce(nullif(province_state, 'MACHINERY'), '') AS province_state
             FROM country_loc)
       WHERE province_state = '' GROUP BY 3 HAVING count(*) > 1""",
    tables=True,
)
def fan_out_report(spark, sf_dir):
    """Countries that get a second country-level row once one segment is blanked."""
    rows = tables(spark, sf_dir).country_loc
    return check_fan_out(rows.withColumn("province_state", F.expr("nullif(province_state, 'MACHINERY')")))
