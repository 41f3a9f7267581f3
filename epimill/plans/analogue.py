"""The warehouse tables as derived from the provided order tables.

A nation stands for a country, a market segment for a province and an order for a
case. The only pass over the big tables joins orders to customers and reduces the
result to one row per (nation, segment, day); that is written once per application
to the shared folder, as a load into a warehouse would be. All queries over cases
and vaccinations read the loaded tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from epimill.functions.dates import date_text
from epimill.operators.series import running_sum
from epimill.session import scratch_path

# Our choice: nations without any vaccination total, and those that only have totals.
NO_TOTAL = (3, 10, 17, 24)
TOTAL_ONLY = (0, 5, 15, 20)
# Regions whose country-level rows have a blank sub-area; the others have a null.
BLANK_REGIONS = (0, 1)

@dataclass(frozen=True)
class Tables:
    daily_case: DataFrame
    vac: DataFrame
    country_loc: DataFrame


_LOADED: dict[tuple[str, str], Tables] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per nation, segment and day: the one join of the big tables."""
    orders = read(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus", "o_orderpriority"
    )
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    status = F.col("o_orderstatus")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "c_mktsegment", "day")
        .agg(
            F.count("*").alias("n_orders"),
            F.count_if(status == "F").alias("n_filled"),
            F.count_if(status != "P").alias("n_not_pending"),
            F.min("o_orderpriority").alias("priority"),
        )
    )


def daily_case(activity: DataFrame, nations: DataFrame) -> DataFrame:
    area = ["c_nationkey", "c_mktsegment"]
    rows = activity.withColumns(
        {
            "confirmed": running_sum(F.col("n_orders"), area, "day"),
            "deaths": running_sum(F.col("n_filled"), area, "day"),
        }
    )
    return rows.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country_region"),
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("province_state"),
        date_text(F.col("day")).alias("date_string"),
        "confirmed",
        "deaths",
    )


def vac(activity: DataFrame, nations: DataFrame) -> DataFrame:
    days = activity.groupBy("c_nationkey", "day").agg(
        F.sum("n_orders").alias("n_orders"),
        F.sum("n_filled").alias("n_filled"),
        F.sum("n_not_pending").alias("n_not_pending"),
        F.min("priority").alias("vaccine"),
    )
    nation = F.col("c_nationkey")
    has_total = ~nation.isin(*NO_TOTAL)
    has_people = ~nation.isin(*TOTAL_ONLY)

    def counted(column: str):
        return running_sum(F.col(column), ["c_nationkey"], "day")

    rows = days.withColumns(
        {
            "total_vaccinations": F.when(has_total, counted("n_orders")),
            "people_vaccinated": F.when(has_people, counted("n_not_pending")),
            "people_fully_vaccinated": F.when(has_people, counted("n_filled")),
        }
    )
    return rows.join(nations, nation == F.col("n_nationkey")).select(
        F.lower("n_name").alias("location"),
        date_text(F.col("day")).alias("date_string"),
        "vaccine",
        "total_vaccinations",
        "people_vaccinated",
        "people_fully_vaccinated",
    )


def country_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per province plus one country-level row per nation."""
    nations = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    provinces = (
        read(spark, sf_dir, "customer")
        .groupBy("c_nationkey", "c_mktsegment")
        .agg((F.count("*") * 1000).alias("population"))
    )
    totals = provinces.groupBy("c_nationkey").agg(F.sum("population").alias("population"))
    blank = F.when(F.col("n_regionkey").isin(*BLANK_REGIONS), "")
    whole = nations.join(totals, F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn(
        "province_state", blank
    )
    parts = nations.join(provinces, F.col("n_nationkey") == F.col("c_nationkey")).withColumn(
        "province_state", F.col("c_mktsegment")
    )
    columns = [
        F.col("n_name").alias("country_region"),
        F.lower("n_name").alias("location"),
        F.col("province_state"),
        F.coalesce("population", F.lit(0)).alias("population"),
        F.initcap("r_name").alias("continent"),
    ]
    return whole.select(*columns).unionByName(parts.select(*columns))


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The loaded tables; loads them on first use in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        root = scratch_path(spark, "analogue")
        nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        daily_activity(spark, sf_dir).write.parquet(f"{root}/activity")
        activity = spark.read.parquet(f"{root}/activity")
        daily_case(activity, nations).write.parquet(f"{root}/daily_case")
        vac(activity, nations).write.parquet(f"{root}/vac")
        country_loc(spark, sf_dir).write.parquet(f"{root}/country_loc")
        names = ("daily_case", "vac", "country_loc")
        _LOADED[key] = Tables(*[spark.read.parquet(f"{root}/{name}") for name in names])
    return _LOADED[key]


# The same tables as DuckDB common table expressions.
ORACLE_TABLES = """
activity AS (
  SELECT c_nationkey, c_mktsegment, CAST(o_orderdate AS DATE) AS day,
         count(*) AS n_orders,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS n_filled,
         count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_not_pending,
         min(o_orderpriority) AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3),
daily_case AS (
  SELECT n_name AS country_region, nullif(c_mktsegment, 'BUILDING') AS province_state,
         strftime(day, '%Y-%m-%d') AS date_string,
         CAST(sum(n_orders) OVER w AS BIGINT) AS confirmed,
         CAST(sum(n_filled) OVER w AS BIGINT) AS deaths
  FROM activity JOIN nation ON c_nationkey = n_nationkey
  WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY day)),
vac_days AS (
  SELECT c_nationkey, day, sum(n_orders) AS n_orders, sum(n_filled) AS n_filled,
         sum(n_not_pending) AS n_not_pending, min(priority) AS vaccine
  FROM activity GROUP BY 1, 2),
vac AS (
  SELECT lower(n_name) AS location, strftime(day, '%Y-%m-%d') AS date_string, vaccine,
         CASE WHEN c_nationkey NOT IN (3, 10, 17, 24)
              THEN CAST(sum(n_orders) OVER w AS BIGINT) END AS total_vaccinations,
         CASE WHEN c_nationkey NOT IN (0, 5, 15, 20)
              THEN CAST(sum(n_not_pending) OVER w AS BIGINT) END AS people_vaccinated,
         CASE WHEN c_nationkey NOT IN (0, 5, 15, 20)
              THEN CAST(sum(n_filled) OVER w AS BIGINT) END AS people_fully_vaccinated
  FROM vac_days JOIN nation ON c_nationkey = n_nationkey
  WINDOW w AS (PARTITION BY c_nationkey ORDER BY day)),
provinces AS (
  SELECT c_nationkey, c_mktsegment, count(*) * 1000 AS population FROM customer GROUP BY 1, 2),
places AS (
  SELECT n_nationkey, n_name, n_regionkey, upper(r_name[1]) || lower(r_name[2:]) AS continent
  FROM nation JOIN region ON n_regionkey = r_regionkey),
country_loc AS (
  SELECT n_name AS country_region, lower(n_name) AS location,
         CASE WHEN n_regionkey IN (0, 1) THEN '' END AS province_state,
         CAST(coalesce((SELECT sum(population) FROM provinces WHERE c_nationkey = n_nationkey), 0)
              AS BIGINT) AS population,
         replace(continent, 'Middle east', 'Middle East') AS continent
  FROM places
  UNION ALL
  SELECT n_name, lower(n_name), c_mktsegment, population,
         replace(continent, 'Middle east', 'Middle East')
  FROM places JOIN provinces ON c_nationkey = n_nationkey)
"""
