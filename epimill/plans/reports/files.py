"""Ingest planning over file names made of the order and ship dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from epimill.functions.dates import file_name_for
from epimill.operators.groups import with_next_day
from epimill.plans.analogue import read
from epimill.plans.quality import both_ways, check_case_dates, check_files, check_time_dates
from epimill.plans.reports.registry import report
from epimill.sources.files import choose_files, names_between, not_landed, with_file_date, with_layout

FILES = """
files AS (SELECT DISTINCT strftime(o_orderdate, '%m-%d-%Y') || '.csv' AS file_name FROM orders),
ledger AS (
  SELECT DISTINCT strftime(l_shipdate, '%m-%d-%Y') || '.csv' AS file_name, 'case' AS data_type
  FROM lineitem
  UNION ALL SELECT file_name, 'vac' FROM files),
dated AS (SELECT file_name, CAST(strptime(split_part(file_name, '.', 1), '%m-%d-%Y') AS DATE) AS file_date FROM files),
ledger_days AS (
  SELECT strftime(strptime(split_part(file_name, '.', 1), '%m-%d-%Y'), '%Y-%m-%d') AS date_string
  FROM ledger WHERE data_type = 'case')
"""
LAYOUT_LAST = "1998-03-21"


def order_files(spark, sf_dir):
    days = read(spark, sf_dir, "orders").select("o_orderdate").distinct()
    return days.select(file_name_for(F.col("o_orderdate")).alias("file_name"))


def ship_ledger(spark, sf_dir):
    shipped = read(spark, sf_dir, "lineitem")
    cases = shipped.select("l_shipdate").distinct()
    cases = cases.select(file_name_for(F.col("l_shipdate")).alias("file_name"), F.lit("case").alias("data_type"))
    return cases.unionByName(order_files(spark, sf_dir).withColumn("data_type", F.lit("vac")))


def order_dates(spark, sf_dir):
    days = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("date_string"))


@report(
    """SELECT file_name, file_date FROM dated
       WHERE file_name NOT IN (SELECT file_name FROM ledger WHERE data_type = 'case')""",
    FILES,
)
def files_to_process(spark, sf_dir):
    chosen = choose_files(order_files(spark, sf_dir), ship_ledger(spark, sf_dir), "case")
    return with_file_date(chosen)


@report("SELECT file_name, file_date FROM dated", FILES)
def files_for_full_reload(spark, sf_dir):
    files = order_files(spark, sf_dir)
    return with_file_date(choose_files(files, ship_ledger(spark, sf_dir), "case", process_all=True))


@report(
    "SELECT file_name, file_date FROM dated WHERE file_date BETWEEN DATE '1996-02-20' AND DATE '1998-06-13'",
    FILES,
)
def files_in_date_range(spark, sf_dir):
    files = order_files(spark, sf_dir)
    ledger = ship_ledger(spark, sf_dir)
    return with_file_date(choose_files(files, ledger, "case", dates=("1996-02-20", "1998-06-13")))


@report(
    """SELECT strftime(day, '%m-%d-%Y') || '.csv' AS file_name,
              EXISTS (SELECT 1 FROM files f
                      WHERE f.file_name = strftime(day, '%m-%d-%Y') || '.csv') AS offered
       FROM (SELECT unnest(generate_series(DATE '1994-12-20', DATE '1996-03-10', INTERVAL 1 DAY)) AS day)""",
    FILES,
)
def date_range_files(spark, sf_dir):
    names = names_between(spark, "1994-12-20", "1996-03-10")
    offered = order_files(spark, sf_dir).withColumn("offered", F.lit(True))
    return names.join(offered, "file_name", "left").select(
        "file_name", F.coalesce("offered", F.lit(False)).alias("offered")
    )


@report(
    """SELECT file_name FROM files
       WHERE file_name NOT IN (SELECT file_name FROM ledger WHERE data_type = 'case')""",
    FILES,
)
def files_not_landed(spark, sf_dir):
    landed = ship_ledger(spark, sf_dir).where("data_type = 'case'")
    return not_landed(order_files(spark, sf_dir), landed)


@report(
    """SELECT file_name, CASE WHEN file_date BETWEEN DATE '1995-01-22' AND DATE '1998-03-21'
                              THEN 'old' ELSE 'new' END AS layout FROM dated""",
    FILES,
)
def route_by_format(spark, sf_dir):
    return with_layout(order_files(spark, sf_dir), "1995-01-22", LAYOUT_LAST)


@report(
    """SELECT 'case files' AS "check", 'only in files' AS direction, file_name AS value FROM files
       WHERE file_name NOT IN (SELECT file_name FROM ledger WHERE data_type = 'case')
       UNION ALL
       SELECT 'case files', 'only in csv_record', file_name FROM ledger
       WHERE data_type = 'case' AND file_name NOT IN (SELECT file_name FROM files)""",
    FILES,
)
def ledger_reconcile(spark, sf_dir):
    return check_files(order_files(spark, sf_dir), ship_ledger(spark, sf_dir), "case")


DATE_CHECK = """
SELECT '{check}' AS "check", 'only in csv_record' AS direction, date_string AS value FROM recorded
WHERE date_string NOT IN (SELECT date_string FROM stored)
UNION ALL
SELECT '{check}', 'only in {table}', date_string FROM stored
WHERE date_string NOT IN (SELECT date_string FROM recorded)
"""
STORED = """,
stored AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date_string FROM orders),
recorded AS (SELECT date_string FROM ledger_days)"""
STORED_NEXT = """,
stored AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date_string FROM orders),
recorded AS (
  SELECT date_string FROM ledger_days
  UNION SELECT strftime(CAST(max(date_string) AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d') FROM ledger_days)"""


@report(DATE_CHECK.format(check="case dates", table="daily_case"), FILES.rstrip() + STORED)
def case_date_gaps(spark, sf_dir):
    return check_case_dates(ship_ledger(spark, sf_dir), order_dates(spark, sf_dir))


@report(DATE_CHECK.format(check="time dates", table="dim_time"), FILES.rstrip() + STORED_NEXT)
def time_date_gaps(spark, sf_dir):
    return check_time_dates(ship_ledger(spark, sf_dir), order_dates(spark, sf_dir), next_day=True)


@report(
    """SELECT CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY 1
       UNION ALL SELECT CAST(max(o_orderdate) AS DATE) + 1 FROM orders"""
)
def dates_and_next_day(spark, sf_dir):
    days = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return with_next_day(days.distinct(), "day")


@report(
    """SELECT 'customers and suppliers' AS "check",
              CASE WHEN c IS NULL THEN 'only in suppliers' ELSE 'only in customers' END AS direction,
              CAST(coalesce(c, s) AS VARCHAR) AS value
       FROM (SELECT DISTINCT c_acctbal AS c FROM customer) FULL JOIN (SELECT DISTINCT s_acctbal AS s FROM supplier)
            ON c = s
       WHERE c IS NULL OR s IS NULL"""
)
def difference_both_ways(spark, sf_dir):
    left = read(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("string"))
    right = read(spark, sf_dir, "supplier").select(F.col("s_acctbal").cast("string"))
    return both_ways("customers and suppliers", left, right, "customers", "suppliers")
