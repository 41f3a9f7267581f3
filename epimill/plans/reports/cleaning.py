"""Cleaning: stamps, counts, repeated rows, point corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from epimill.functions.dates import (
    date_text,
    file_name_for,
    parse_iso_date,
    parse_stamp_date,
    parse_timestamp,
    timestamp_text,
)
from epimill.functions.numbers import whole_number
from epimill.functions.texts import first_part
from epimill.operators.joins import add_time_parts
from epimill.operators.shape import blank_keys, correct_stamps, corrections_table, first_per_key, null_nans
from epimill.plans.analogue import read
from epimill.plans.conform import time_rows
from epimill.plans.reports.registry import report

# Order dates written in the six stamp forms, one form per pair of months; the
# time of day repeats month and day. Low-priority pending orders hold junk.
STAMP_FORMATS = [
    "yyyy-MM-dd MM:dd:MM",
    "yyyy-MM-dd MM:dd",
    "yyyy-MM-dd'T'MM:dd:MM",
    "yyyy-MM-dd'T'MM:dd",
    "M/d/yy MM:dd",
    "M/d/yyyy MM:dd",
]
STAMPS = """
stamps AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'junk'
              WHEN month(o_orderdate) <= 2 THEN strftime(o_orderdate, '%Y-%m-%d %m:%d:%m')
              WHEN month(o_orderdate) <= 4 THEN strftime(o_orderdate, '%Y-%m-%d %m:%d')
              WHEN month(o_orderdate) <= 6 THEN strftime(o_orderdate, '%Y-%m-%dT%m:%d:%m')
              WHEN month(o_orderdate) <= 8 THEN strftime(o_orderdate, '%Y-%m-%dT%m:%d')
              WHEN month(o_orderdate) <= 10 THEN strftime(o_orderdate, '%-m/%-d/%y %m:%d')
              ELSE strftime(o_orderdate, '%-m/%-d/%Y %m:%d') END AS stamp
  FROM orders),
parsed AS (
  SELECT o_orderkey, stamp,
         try_strptime(stamp, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M:%S',
                              '%Y-%m-%dT%H:%M', '%m/%d/%y %H:%M', '%m/%d/%Y %H:%M']) AS ts
  FROM stamps),
parts AS (
  SELECT DISTINCT strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_update, strftime(ts, '%Y-%m-%d') AS date_string,
         CAST(hour(ts) AS INT) AS hour, CAST(day(ts) AS INT) AS day, CAST(week(ts) AS INT) AS week,
         CAST(month(ts) AS INT) AS month, CAST(year(ts) AS INT) AS year,
         CAST(isodow(ts) - 1 AS INT) AS weekday
  FROM parsed WHERE ts IS NOT NULL)
"""


def stamp_text():
    day, month = F.col("o_orderdate"), F.month("o_orderdate")
    text = F.date_format(day, STAMP_FORMATS[-1])
    for place in range(len(STAMP_FORMATS) - 2, -1, -1):
        text = F.when(month <= 2 * place + 2, F.date_format(day, STAMP_FORMATS[place])).otherwise(text)
    junk = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    return F.when(junk, "junk").otherwise(text)


def stamped_orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", stamp_text().alias("stamp"))


@report(
    """SELECT o_orderkey, stamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text,
              CAST(ts AS DATE) AS day FROM parsed""",
    STAMPS,
)
def parse_mixed_timestamps(spark, sf_dir):
    rows = stamped_orders(spark, sf_dir).withColumn("ts", parse_timestamp(F.col("stamp")))
    return rows.select(
        "o_orderkey", "stamp", timestamp_text(F.col("ts")).alias("ts_text"), F.to_date("ts").alias("day")
    )


@report(
    """SELECT o_orderkey, text,
              CAST(try_strptime(split_part(replace(text, 'T', ' '), ' ', 1),
                                ['%Y-%m-%d', '%m/%d/%y', '%m/%d/%Y']) AS DATE) AS day
       FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN split_part(stamp, ' ', 1) ELSE stamp END AS text
             FROM stamps JOIN orders USING (o_orderkey))""",
    STAMPS,
)
def stamp_dates(spark, sf_dir):
    """Dates of stamps in any form; filled orders have stamps without a time."""
    stamp = stamp_text()
    text = F.when(F.col("o_orderstatus") == "F", first_part(stamp, " ")).otherwise(stamp)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.withColumn("day", parse_stamp_date(F.col("text")))


@report("SELECT * FROM parts", STAMPS)
def time_dimension(spark, sf_dir):
    return time_rows(stamped_orders(spark, sf_dir), "stamp")


@report(
    """SELECT o_orderkey, stamp, date_string, hour, day, week, month, year, weekday
       FROM parsed LEFT JOIN parts ON strftime(ts, '%Y-%m-%d %H:%M:%S') = last_update""",
    STAMPS,
)
def case_time_join(spark, sf_dir):
    rows = stamped_orders(spark, sf_dir)
    return add_time_parts(rows, time_rows(rows, "stamp"), "stamp")


@report(
    """SELECT o_orderkey, CAST(try_strptime(text, '%Y-%m-%d') AS DATE) AS day,
              strftime(try_strptime(text, '%Y-%m-%d'), '%Y-%m-%d') AS date_string
       FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'no date'
                                     ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders)"""
)
def iso_dates(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderstatus") == "P", "no date").otherwise(iso)
    day = parse_iso_date(F.col("text"))
    return (
        read(spark, sf_dir, "orders")
        .select("o_orderkey", text.alias("text"))
        .select("o_orderkey", day.alias("day"), date_text(day).alias("date_string"))
    )


@report(
    """SELECT l_orderkey, l_linenumber, text, CAST(round_even(TRY_CAST(text AS DOUBLE), 0) AS BIGINT) AS whole
       FROM (SELECT l_orderkey, l_linenumber,
                    CASE WHEN l_quantity > 1 THEN CAST(l_quantity / 2 AS VARCHAR) ELSE '' END AS text
             FROM lineitem)"""
)
def half_even_counts(spark, sf_dir):
    half = (F.col("l_quantity") / 2).cast("string")
    return (
        read(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey",
            "l_linenumber",
            F.when(F.col("l_quantity") > 1, half).otherwise("").alias("text"),
        )
        .withColumn("whole", whole_number(F.col("text")))
    )


@report(
    """SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority
                                  ORDER BY o_orderstatus, o_orderdate, o_orderkey) = 1"""
)
def dedupe_keep_first(spark, sf_dir):
    kept = first_per_key(
        read(spark, sf_dir, "orders"),
        ["o_custkey", "o_orderpriority"],
        ["o_orderstatus", "o_orderdate", "o_orderkey"],
    )
    return kept.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")


CORRECTIONS = [
    ("06-01-1996.csv", "3-MEDIUM", "1996-06-01", "1996-06-02"),
    ("06-12-1997.csv", "5-LOW", "1997-06-12", "1997-06-13"),
    ("03-01-1998.csv", "1-URGENT", "1998-03-05", "1998-03-06"),
]


@report(
    """SELECT o_orderkey, source_file, province_state,
              CASE WHEN new_day IS NOT NULL AND left(last_update, 10) = old_day
                   THEN new_day || substr(last_update, 11) ELSE last_update END AS last_update
       FROM (SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') || '.csv' AS source_file,
                    o_orderpriority AS province_state,
                    strftime(o_orderdate, '%Y-%m-%d %m:%d:%m') AS last_update FROM orders)
       LEFT JOIN (VALUES ('06-01-1996.csv', '3-MEDIUM', '1996-06-01', '1996-06-02'),
                         ('06-12-1997.csv', '5-LOW', '1997-06-12', '1997-06-13'),
                         ('03-01-1998.csv', '1-URGENT', '1998-03-05', '1998-03-06'))
                 AS fixes(source_file, province_state, old_day, new_day)
       USING (source_file, province_state)"""
)
def point_corrections(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        file_name_for(F.col("o_orderdate")).alias("source_file"),
        F.col("o_orderpriority").alias("province_state"),
        F.date_format("o_orderdate", STAMP_FORMATS[0]).alias("last_update"),
    )
    return correct_stamps(rows, corrections_table(spark, CORRECTIONS))


@report(
    """SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), '') AS priority,
              coalesce(nullif(o_orderstatus, 'P'), '') AS status FROM orders"""
)
def key_nulls_filled(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"),
        F.expr("nullif(o_orderstatus, 'P')").alias("status"),
    )
    return blank_keys(rows, ["priority", "status"])


@report(
    """SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount
       FROM lineitem"""
)
def nan_measures(spark, sf_dir):
    """Zero rates written as NaN come out as null."""
    columns = ["l_tax", "l_discount"]
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns)
    missing = {name: F.when(F.col(name) == 0, F.lit(float("nan"))).otherwise(F.col(name)) for name in columns}
    return null_nans(rows.withColumns(missing), columns)
