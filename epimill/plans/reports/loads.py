"""Merges, and whole loads from CSV files that Spark writes from the tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from epimill.functions.dates import file_name_for
from epimill.plans.analogue import read, tables
from epimill.plans.landing import land_cases, land_lookup, rewrite_old_cases
from epimill.plans.update import (
    Landing,
    case_files,
    load_cases,
    load_lookup,
    load_vaccinations,
    read_vaccination_totals,
)
from epimill.plans.reports.registry import report
from epimill.session import scratch_path
from epimill.sinks.csv_files import add_parts, write_csv, write_reports
from epimill.sinks.merge import insert_if_absent, replace_rows, upsert
from epimill.sinks.warehouse import Warehouse
from epimill.sources.csv_files import broken_rows, read_csv_files
from epimill.sources.files import list_files
from epimill.streaming.ingest import ingest_reports, stream_landing

ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def stored_orders(spark, sf_dir):
    """Filled and open orders as stored rows."""
    return read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(*ORDER_COLUMNS)


def changed_orders(spark, sf_dir):
    """Open and pending orders as a batch with other prices and priorities."""
    rows = read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(*ORDER_COLUMNS)
    return rows.withColumns(
        {"o_totalprice": F.col("o_totalprice") + 0.5, "o_orderpriority": F.lit("changed")}
    )


@report(
    """SELECT o_orderkey, o_orderstatus,
              CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice + 0.5::DOUBLE END AS o_totalprice,
              CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE o_orderpriority END AS o_orderpriority
       FROM orders"""
)
def upsert_update(spark, sf_dir):
    return upsert(stored_orders(spark, sf_dir), changed_orders(spark, sf_dir), ["o_orderkey"], ["o_totalprice"])


@report(
    """SELECT o_orderkey, o_orderstatus, o_totalprice + 0.5::DOUBLE AS o_totalprice,
              'changed' AS o_orderpriority FROM orders WHERE o_orderstatus = 'P'"""
)
def upsert_ignore(spark, sf_dir):
    return insert_if_absent(stored_orders(spark, sf_dir), changed_orders(spark, sf_dir), ["o_orderkey"])


@report(
    """SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
       WHERE o_orderstatus <> 'P' AND NOT (o_orderpriority = '2-HIGH' AND o_totalprice BETWEEN 50000 AND 300000)
       UNION ALL
       SELECT o_orderkey, o_orderstatus, o_totalprice + 0.5::DOUBLE, 'changed' FROM orders
       WHERE o_orderstatus <> 'F'"""
)
def delete_reload(spark, sf_dir):
    doomed = (F.col("o_orderpriority") == "2-HIGH") & F.col("o_totalprice").between(50000, 300000)
    return replace_rows(stored_orders(spark, sf_dir), changed_orders(spark, sf_dir), doomed)


@report(
    """SELECT coalesce(l.file_name, n.file_name) AS file_name,
              CASE WHEN n.file_name IS NULL THEN 'first load' ELSE 'second load' END AS last_update, 'case' AS data_type
       FROM (SELECT DISTINCT strftime(l_shipdate, '%m-%d-%Y') || '.csv' AS file_name FROM lineitem) l
       FULL JOIN (SELECT DISTINCT strftime(o_orderdate, '%m-%d-%Y') || '.csv' AS file_name FROM orders) n
            ON l.file_name = n.file_name"""
)
def ledger_upsert(spark, sf_dir):
    def entries(name, column, label):
        days = read(spark, sf_dir, name).select(column).distinct()
        return days.select(
            file_name_for(F.col(column)).alias("file_name"),
            F.lit(label).alias("last_update"),
            F.lit("case").alias("data_type"),
        )

    first = entries("lineitem", "l_shipdate", "first load")
    second = entries("orders", "o_orderdate", "second load")
    return upsert(first, second, ["file_name", "data_type"], ["last_update"])


# Daily reports made of the events: one report per day, event types as countries and
# users as provinces. Reports of the first ten days have the older header. In the
# newer ones, error rows appear a second time with another count.
# The column names of the two layouts.
NEW_HEADER = [
    "_c0", "FIPS", "Admin2", "Province_State", "Country_Region", "Last_Update",
    "Confirmed", "Deaths", "Recovered", "Active",
]
OLD_NAMES = {"Province_State": "Province/State", "Country_Region": "Country/Region", "Last_Update": "Last Update"}
OLD_HEADER = [*OLD_NAMES.values(), "Confirmed", "Deaths", "Recovered"]
LAST_OLD_DAY = "2024-01-10"
IN_OLD_LAYOUT = f"day <= DATE '{LAST_OLD_DAY}'"

EVENT_CASES = """
event_days AS (
  SELECT CAST(ts AS DATE) AS day, event_type, user_id, count(*) AS n,
         count(*) FILTER (WHERE value > 50) AS n_high, max(ts) AS last_ts
  FROM events GROUP BY 1, 2, 3),
cases AS (
  SELECT CASE WHEN day > DATE '2024-01-10' THEN lpad(CAST(user_id AS VARCHAR), 5, '0') ELSE '' END AS fips,
         '' AS admin2, 'user ' || user_id AS province_state, event_type AS country_region,
         strftime(day, '%Y-%m-%d') AS date_string,
         strftime(last_ts, '%Y-%m-%dT%H:%M:%S') AS last_update,
         CAST(n AS INT) AS confirmed, CAST(n_high AS INT) AS deaths, CAST(NULL AS INT) AS recovered,
         CASE WHEN day > DATE '2024-01-10' THEN CAST(n - n_high AS INT) END AS active, day AS date_case
  FROM event_days)
"""


def event_reports(spark, sf_dir):
    day = F.col("ts").cast("date")
    rows = (
        read(spark, sf_dir, "events")
        .groupBy(day.alias("day"), "event_type", "user_id")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("value") > 50).alias("n_high"),
            F.max("ts").alias("last_ts"),
        )
    )
    stamp = F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss")

    def count_text(value):
        return F.concat(value.cast("string"), F.lit(".0"))

    return rows.select(
        "day",
        file_name_for(F.col("day")).alias("report"),
        F.lpad(F.col("user_id").cast("string"), 5, "0").alias("FIPS"),
        F.lit(None).cast("string").alias("Admin2"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("Province_State"),
        F.col("event_type").alias("Country_Region"),
        stamp.alias("Last_Update"),
        count_text(F.col("n")).alias("Confirmed"),
        count_text(F.col("n_high")).alias("Deaths"),
        F.lit(None).cast("string").alias("Recovered"),
        count_text(F.col("n") - F.col("n_high")).alias("Active"),
    )


def land_event_reports(spark, sf_dir, root: str, rows: DataFrame | None = None) -> Landing:
    """Write the reports, all or the given rows, as CSV, in one folder per layout."""
    landing = Landing(root, cases="daily_case_data/", old_cases="daily_case_data/old_format/")
    rows = event_reports(spark, sf_dir) if rows is None else rows
    new = rows.where(f"NOT {IN_OLD_LAYOUT}")
    again = new.where("Country_Region = 'error'").withColumn("Confirmed", F.lit("999.0"))
    write_reports(new.unionByName(again).select(*NEW_HEADER[1:], "report"), landing.path(landing.cases))
    old_rows = rows.where(IN_OLD_LAYOUT).withColumnsRenamed(OLD_NAMES).select(*OLD_HEADER, "report")
    write_reports(old_rows, landing.path(landing.old_cases))
    return landing


def land_nation_files(spark, sf_dir, landing: Landing) -> None:
    """Vaccination counts as one CSV per nation, and the two lookups."""
    counts = tables(spark, sf_dir).vac.select(
        "location",
        F.col("date_string").alias("date"),
        "vaccine",
        F.lit("source").alias("source_url"),
        F.concat(F.col("total_vaccinations").cast("string"), F.lit(".0")).alias("total_vaccinations"),
        "people_vaccinated",
        "people_fully_vaccinated",
        F.concat("location", F.lit(".csv")).alias("report"),
    )
    write_reports(counts, landing.path(landing.vaccinations))
    nations = read(spark, sf_dir, "nation")
    areas = (
        read(spark, sf_dir, "customer")
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(F.min("c_custkey").alias("uid"), F.count("*").alias("n"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("uid").alias("UID"),
            F.lit("NA").alias("iso2"),
            F.lit("NAM").alias("iso3"),
            F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")).alias("code3"),
            F.lit("").alias("FIPS"),
            F.lit(None).cast("string").alias("Admin2"),
            F.col("c_mktsegment").alias("Province_State"),
            F.col("n_name").alias("Country_Region"),
            F.lit("1.5").alias("Lat"),
            F.lit("-2.5").alias("Long_"),
            F.concat_ws(", ", "c_mktsegment", "n_name").alias("Combined_Key"),
            F.concat((F.col("n") * 1000).cast("string"), F.lit(".0")).alias("Population"),
        )
    )
    write_csv(areas, landing.path(landing.areas))
    regions = read(spark, sf_dir, "region")
    locations = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    write_csv(
        locations.select(
            F.expr("if(n_regionkey = 4, concat('place ', n_name), n_name)").alias("Country/Region"),
            F.lower("n_name").alias("location"),
            F.initcap("r_name").alias("continent"),
        ),
        landing.path(landing.locations),
    )


_INGESTED: dict[tuple[str, str, str], Warehouse] = {}


def new_warehouse(spark) -> Warehouse:
    name = f"epimill_{uuid.uuid4().hex}"
    warehouse = Warehouse(spark, name, scratch_path(spark, "warehouse"))
    warehouse.create_tables()
    return warehouse


def ingested_cases(spark, sf_dir) -> Warehouse:
    """Warehouse with the event reports, loaded once per application.

    They come in three loads: a date range, the rest by ledger, and once more by
    ledger, which finds nothing new.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "cases")
    if key not in _INGESTED:
        landing = land_event_reports(spark, sf_dir, scratch_path(spark, "landing"))
        warehouse = new_warehouse(spark)
        load_cases(warehouse, landing, dates=("2024-01-05", "2024-01-20"))
        load_cases(warehouse, landing)
        if load_cases(warehouse, landing):
            raise RuntimeError("the ledger did not keep processed files out")
        _INGESTED[key] = warehouse
    return _INGESTED[key]


def ingested_nations(spark, sf_dir) -> Warehouse:
    """Warehouse with the vaccination files and, loaded twice, the lookups."""
    key = (spark.sparkContext.applicationId, sf_dir, "nations")
    if key not in _INGESTED:
        landing = Landing(scratch_path(spark, "landing"))
        land_nation_files(spark, sf_dir, landing)
        warehouse = new_warehouse(spark)
        load_vaccinations(warehouse, landing)
        load_lookup(warehouse, landing)
        load_lookup(warehouse, landing)
        _INGESTED[key] = warehouse
    return _INGESTED[key]


@report("SELECT * FROM cases", EVENT_CASES)
def ingest_cases(spark, sf_dir):
    return ingested_cases(spark, sf_dir).read("daily_case")


@report(
    """SELECT DISTINCT strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_update, strftime(ts, '%Y-%m-%d') AS date_string,
              CAST(hour(ts) AS INT) AS hour, CAST(day(ts) AS INT) AS day, CAST(week(ts) AS INT) AS week,
              CAST(month(ts) AS INT) AS month, CAST(year(ts) AS INT) AS year,
              CAST(isodow(ts) - 1 AS INT) AS weekday
       FROM (SELECT date_trunc('second', last_ts) AS ts FROM event_days)""",
    EVENT_CASES,
)
def ingest_times(spark, sf_dir):
    return ingested_cases(spark, sf_dir).read("dim_time")


@report(
    """SELECT DISTINCT strftime(ts, '%m-%d-%Y') || '.csv' AS file_name, 'case' AS data_type FROM events
       UNION ALL SELECT DISTINCT location || '.csv', 'vac' FROM vac""",
    tables=True,
)
def ingest_ledger(spark, sf_dir):
    cases, nations = ingested_cases(spark, sf_dir), ingested_nations(spark, sf_dir)
    entries = cases.read("csv_record").unionByName(nations.read("csv_record"))
    return entries.select("file_name", "data_type")


@report(
    """SELECT location, date_string, date_string AS date_org, vaccine, total_vaccinations,
              people_vaccinated, people_fully_vaccinated FROM vac""",
    tables=True,
)
def ingest_vaccinations(spark, sf_dir):
    return ingested_nations(spark, sf_dir).read("vac")


@report(
    """SELECT coalesce(a.country_region, l.country_region) AS country_region, coalesce(l.location, '') AS location,
              CAST(uid AS INT) AS uid, CASE WHEN known THEN 'NA' END AS iso2, CASE WHEN known THEN 'NAM' END AS iso3,
              CAST(nationkey AS INT) AS code3, '' AS fips, '' AS admin2,
              coalesce(province_state, '') AS province_state,
              province_state || ', ' || a.country_region AS combined_key,
              CASE WHEN known THEN CAST(1.5 AS FLOAT) END AS lat, CASE WHEN known THEN CAST(-2.5 AS FLOAT) END AS long_,
              CAST(n * 1000 AS INT) AS population, continent
       FROM (SELECT n_name AS country_region, c_mktsegment AS province_state, c_nationkey AS nationkey,
                    min(c_custkey) AS uid, count(*) AS n, true AS known
             FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3) a
       FULL JOIN (SELECT CASE WHEN n_regionkey = 4 THEN 'place ' ELSE '' END || n_name AS country_region,
                         lower(n_name) AS location,
                         replace(continent, 'Middle east', 'Middle East') AS continent
                  FROM places) l ON a.country_region = l.country_region""",
    tables=True,
)
def ingest_lookup(spark, sf_dir):
    return ingested_nations(spark, sf_dir).read("country_loc")


def in_days(first: str, last: str):
    return F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))


CHANGED_CASES = """,
changed AS (SELECT * REPLACE (CASE WHEN day BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'
                              THEN CAST(confirmed + 1000 AS INT) ELSE confirmed END AS confirmed)
            FROM (SELECT *, date_case AS day FROM cases))
"""


def changed_reports(spark, sf_dir):
    """Reports of some days with other counts and stamps."""
    rows = event_reports(spark, sf_dir)
    more = F.concat((F.col("Confirmed").cast("double") + 1000).cast("string"))
    other = in_days("2024-01-08", "2024-01-12")
    return rows.withColumns(
        {
            "Confirmed": F.when(other, more).otherwise(F.col("Confirmed")),
            "Last_Update": F.when(other, F.lit("2025-01-01T00:00:00")).otherwise(F.col("Last_Update")),
        }
    )


@report("SELECT * EXCLUDE (day) FROM changed", EVENT_CASES.rstrip() + CHANGED_CASES)
def ingest_case_changes(spark, sf_dir):
    """Stored rows are updated by a second batch: its counts, but the stamps of the first."""
    warehouse = new_warehouse(spark)
    load_cases(warehouse, land_event_reports(spark, sf_dir, scratch_path(spark, "landing")))
    changed = changed_reports(spark, sf_dir).where(in_days("2024-01-08", "2024-01-12"))
    again = land_event_reports(spark, sf_dir, scratch_path(spark, "landing"), changed)
    load_cases(warehouse, again, dates=("2024-01-08", "2024-01-12"))
    return warehouse.read("daily_case")


@report(
    """SELECT location, date_string, date_string AS date_org, vaccine,
              total_vaccinations + CASE WHEN location > 'nation_2' THEN 7 ELSE 0 END AS total_vaccinations,
              people_vaccinated, people_fully_vaccinated FROM vac""",
    tables=True,
)
def ingest_vaccination_changes(spark, sf_dir):
    """A second load of rewritten files updates the stored rows."""
    landing, warehouse = Landing(scratch_path(spark, "landing")), new_warehouse(spark)
    land_nation_files(spark, sf_dir, landing)
    load_vaccinations(warehouse, landing)
    counts = tables(spark, sf_dir).vac.where("location > 'nation_2'").select(
        "location",
        F.col("date_string").alias("date"),
        "vaccine",
        (F.col("total_vaccinations") + 7).cast("string").alias("total_vaccinations"),
        "people_vaccinated",
        "people_fully_vaccinated",
        F.concat("location", F.lit(".csv")).alias("report"),
    )
    write_reports(counts, landing.path(landing.vaccinations))
    load_vaccinations(warehouse, landing)
    return warehouse.read("vac")


@report(
    """SELECT c_mktsegment AS province_state, n_name AS country_region, CAST(min(c_custkey) AS INT) AS uid
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1, 2
       UNION ALL
       SELECT c_mktsegment, n_name, CAST(-min(c_custkey) AS INT)
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1, 2"""
)
def ingest_lookup_changes(spark, sf_dir):
    """A second lookup with other codes: stored rows stay, rows with new keys come in."""
    landing, warehouse = Landing(scratch_path(spark, "landing")), new_warehouse(spark)
    rows = (
        read(spark, sf_dir, "customer")
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("c_mktsegment").alias("Province_State"), F.col("n_name").alias("Country_Region"))
        .agg(F.min("c_custkey").alias("UID"))
    )
    texts = ["iso2", "iso3", "code3", "FIPS", "Admin2", "Lat", "Long_", "Combined_Key", "Population"]
    rows = rows.withColumns({name: F.lit(None).cast("string") for name in texts})
    places = rows.limit(0).select(
        "Country_Region", F.col("iso2").alias("location"), F.col("iso3").alias("continent")
    )
    batches = (
        ("first", rows.where("Province_State <> 'MACHINERY'")),
        ("second", rows.withColumn("UID", -F.col("UID"))),
    )
    for name, batch in batches:
        here = replace(landing, areas=f"{name}/areas.csv", locations=f"{name}/locations.csv")
        write_csv(batch, here.path(here.areas))
        write_csv(places, here.path(here.locations))
        load_lookup(warehouse, here)
    return warehouse.read("country_loc").select("province_state", "country_region", "uid")


@report(
    """SELECT * EXCLUDE (day, reloaded, confirmed_before) REPLACE (
                CASE WHEN reloaded AND day <= DATE '2024-01-12' THEN '2025-01-01T00:00:00' ELSE last_update END
                  AS last_update,
                CASE WHEN reloaded THEN confirmed ELSE confirmed_before END AS confirmed)
       FROM (SELECT c.*, b.confirmed AS confirmed_before,
                    c.country_region = 'click' AND c.day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AS reloaded
             FROM changed c JOIN cases b USING (province_state, country_region, date_case))
       WHERE NOT (reloaded AND province_state = 'user 1')""",
    EVENT_CASES.rstrip() + CHANGED_CASES,
)
def reload_country(spark, sf_dir):
    """Delete one country's rows in a date range and load its changed files: other counts, one area gone."""
    warehouse = new_warehouse(spark)
    load_cases(warehouse, land_event_reports(spark, sf_dir, scratch_path(spark, "landing")))
    changed = changed_reports(spark, sf_dir).where("Province_State <> 'user 1'")
    again = land_event_reports(spark, sf_dir, scratch_path(spark, "landing"), changed)
    load_cases(warehouse, again, dates=("2024-01-08", "2024-01-14"), reload_country="click")
    return warehouse.read("daily_case")


@report("SELECT * FROM cases", EVENT_CASES)
def reload_new_files(spark, sf_dir):
    """Files first read for one country alone are still loaded for the others by ledger."""
    landing = land_event_reports(spark, sf_dir, scratch_path(spark, "landing"))
    warehouse = new_warehouse(spark)
    load_cases(warehouse, landing, dates=("2024-01-05", "2024-01-20"), reload_country="click")
    load_cases(warehouse, landing)
    return warehouse.read("daily_case")


@report("SELECT * EXCLUDE (day) FROM changed", EVENT_CASES.rstrip() + CHANGED_CASES)
def ingest_in_batches(spark, sf_dir):
    """Reports landed and loaded in batches of about sixteen, as a backlog of many files would be; then some changed ones."""
    source, landing = scratch_path(spark, "source"), Landing(scratch_path(spark, "landing"))
    published = land_event_reports(spark, sf_dir, source)
    warehouse = new_warehouse(spark)
    landed = land_cases(spark, published.root, landing, reports_per_batch=16)
    if load_cases(warehouse, landing, reports_per_batch=16) != landed or load_cases(warehouse, landing):
        raise RuntimeError("not every landed report has been loaded and booked")
    changed = changed_reports(spark, sf_dir).where(in_days("2024-01-08", "2024-01-12"))
    again = land_event_reports(spark, sf_dir, scratch_path(spark, "landing"), changed)
    load_cases(warehouse, again, dates=("2024-01-08", "2024-01-12"), reports_per_batch=3)
    return warehouse.read("daily_case")


EVEN_DAY = "day(CAST(day AS DATE)) % 2 = 0"


def parts_before(rows: DataFrame) -> DataFrame:
    """Report rows with an index that puts them before all rows of ``write_reports``."""
    return rows.withColumn("row", F.monotonically_increasing_id() - F.lit(1 << 60))


@report(
    f"""SELECT * EXCLUDE (day, late) REPLACE (
                CASE WHEN late THEN '2025-01-01T00:00:00' ELSE last_update END AS last_update,
                CASE WHEN late THEN confirmed + 1000 ELSE confirmed END AS confirmed)
       FROM (SELECT *, date_case AS day, {EVEN_DAY.replace('day AS DATE', 'date_case AS DATE')} AND country_region = 'click' AS late FROM cases)""",
    EVENT_CASES,
)
def stream_ingest(spark, sf_dir):
    """Reports of both layouts by one stream and one checkpoint, run again after further parts have come.

    The late parts hold rows of areas that were not there, and rows that come before stored ones of
    their key and replace them as a whole. The second run may only meet the reports that
    have new parts.
    """
    rows = event_reports(spark, sf_dir)
    even, added = F.expr(EVEN_DAY), F.col("Country_Region") == "error"
    landing = land_event_reports(spark, sf_dir, scratch_path(spark, "landing"), rows.where(~(even & added)))
    warehouse, checkpoint = new_warehouse(spark), scratch_path(spark, "stream")
    ingest_reports(warehouse, stream_landing(spark, landing), checkpoint)

    changed = F.col("Country_Region") == "click"
    late = parts_before(rows.where(even & (added | changed))).withColumns(
        {
            "Last_Update": F.when(changed, "2025-01-01T00:00:00").otherwise(F.col("Last_Update")),
            "Confirmed": F.when(changed, F.concat((F.col("Confirmed").cast("double") + 1000).cast("int").cast("string"), F.lit(".0")))
            .otherwise(F.col("Confirmed")),
        }
    )
    for names, folder, own in (
        (NEW_HEADER[1:], landing.cases, f"NOT {IN_OLD_LAYOUT}"), (OLD_HEADER, landing.old_cases, IN_OLD_LAYOUT)
    ):
        parts = late.where(own).withColumnsRenamed(OLD_NAMES if folder == landing.old_cases else {})
        add_parts(parts.select("row", *names, "report"), landing.path(folder), index="row")
    loaded = ingest_reports(warehouse, stream_landing(spark, landing), checkpoint)
    if loaded != late.select("report").distinct().count():
        raise RuntimeError(f"{loaded} reports have been read again")
    return warehouse.read("daily_case")


def wide_reports(spark, sf_dir) -> Landing:
    """Reports with columns that no load reads; in one of them, error rows have a line break."""
    landing = Landing(scratch_path(spark, "landing"))
    name = F.concat("Province_State", F.when(F.col("Country_Region") == "error", ",\n").otherwise(", "), "Country_Region")
    rows = event_reports(spark, sf_dir).where(f"NOT {IN_OLD_LAYOUT}")
    rows = rows.withColumns({"Lat": F.lit("1.5"), "Long_": F.lit("-2.5"), "Combined_Key": name})
    write_reports(rows.select(*NEW_HEADER[1:], "Combined_Key", "Lat", "Long_", "report"), landing.path(landing.cases))
    return landing


@report(
    """SELECT source_file, unnest([head || '"' || province_state || ',', 'error",1.5,-2.5']) AS text
       FROM (SELECT strftime(date_case, '%m-%d-%Y') || '.csv' AS source_file, province_state,
                    concat_ws(',', fips, '', province_state, country_region, last_update, confirmed || '.0', deaths || '.0',
                              '', active || '.0', '') AS head
             FROM cases WHERE date_case > DATE '2024-01-10' AND country_region = 'error')""",
    EVENT_CASES,
)
def broken_report_rows(spark, sf_dir):
    """Rows that a line break tears apart in a column that no load reads: the load stops, and they are listed."""
    landing, warehouse = wide_reports(spark, sf_dir), new_warehouse(spark)
    try:
        load_cases(warehouse, landing)
    except Exception as error:
        if "no row of its header" not in str(error):
            raise
    else:
        raise RuntimeError("broken rows have been loaded")
    if not warehouse.read("csv_record").isEmpty() or not warehouse.read("daily_case").isEmpty():
        raise RuntimeError("a load that stopped has stored rows")
    paths = [row[0] for row in case_files(spark, landing).select("report_path").distinct().collect()]
    without_index = F.regexp_replace("text", "^[0-9]+,", "")
    return broken_rows(spark, paths).select("source_file", without_index.alias("text"))


@report("SELECT * FROM cases WHERE date_case > DATE '2024-01-10'", EVENT_CASES)
def ingest_line_breaks(spark, sf_dir):
    """The same reports, read with values over several lines."""
    landing, warehouse = wide_reports(spark, sf_dir), new_warehouse(spark)
    load_cases(warehouse, landing, multi_line=True)
    return warehouse.read("daily_case")


@report(
    "SELECT location, date_string AS date, CAST(total_vaccinations AS VARCHAR) AS total_vaccinations FROM vac", tables=True
)
def vaccination_totals(spark, sf_dir):
    """The aggregated vaccination file, landed by its exact name from below a source folder, and read."""
    rows = tables(spark, sf_dir).vac.select(
        "location",
        F.upper("location").alias("iso_code"),
        F.col("date_string").alias("date"),
        F.col("total_vaccinations").cast("string").alias("total_vaccinations"),
        "people_vaccinated",
    )
    source, landing = scratch_path(spark, "source"), Landing(scratch_path(spark, "landing"))
    write_csv(rows, f"{source}/public/data/{landing.vaccination_totals}")
    write_csv(rows.limit(3), f"{source}/public/data/old-{landing.vaccination_totals}")
    if not land_lookup(spark, source, landing.vaccination_totals, landing.path(landing.vaccination_totals)):
        raise RuntimeError("the file was not found by its name")
    return read_vaccination_totals(spark, landing, ["location", "date", "total_vaccinations"])


@report(
    """SELECT strftime(day, '%m-%d-%Y') || '.csv' AS file_name,
              CASE WHEN day > DATE '2024-01-10' THEN 'new' ELSE 'old' END AS layout
       FROM event_days GROUP BY 1, 2""",
    EVENT_CASES,
)
def landed_files(spark, sf_dir):
    """Recursive listing of landed reports against listings of the two folders."""
    landing = land_event_reports(spark, sf_dir, scratch_path(spark, "landing"))
    everything = list_files(spark, landing.path(landing.cases), recursive=True).select("file_name").distinct()
    own = list_files(spark, landing.path(landing.cases)).select("file_name", F.lit("new").alias("layout"))
    return everything.join(own.distinct(), "file_name", "left").select(
        "file_name", F.coalesce("layout", F.lit("old")).alias("layout")
    )


@report(
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, o_orderstatus, 'a "quoted", text' || chr(10) || 'in two lines' AS note
       FROM orders"""
)
def csv_round_trip(spark, sf_dir):
    """Write a table as CSV with quotes and commas in it, and read it back by header."""
    path = scratch_path(spark, "csv")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    write_csv(rows.withColumn("note", F.lit('a "quoted", text\nin two lines')), f"{path}/orders.csv")
    columns = ["o_orderkey", "o_orderpriority", "o_orderstatus", "note"]
    return read_csv_files(spark, [f"{path}/orders.csv"], columns, multi_line=True).select(*columns)


REPORT_TEXT = """
  SELECT strftime(day, '%m-%d-%Y') || '.csv' AS source_file, 'user ' || user_id AS "Province_State",
         event_type AS "Country_Region", strftime(last_ts, '%Y-%m-%dT%H:%M:%S') AS "Last_Update",
         n || '.0' AS "Confirmed", n_high || '.0' AS "Deaths"
  FROM event_days
"""
TEXT_COLUMNS = ["Province_State", "Country_Region", "Last_Update", "Confirmed", "Deaths"]


@report(f"{REPORT_TEXT} WHERE day <= DATE '2024-01-10'", EVENT_CASES)
def rewrite_old_reports(spark, sf_dir):
    """Old-layout reports written again with the newer column names."""
    landing = land_event_reports(spark, sf_dir, scratch_path(spark, "landing"))
    target = landing.path("rewritten")
    rewrite_old_cases(spark, landing, target)
    paths = [row[0] for row in list_files(spark, target).select("report_path").distinct().collect()]
    return read_csv_files(spark, paths, TEXT_COLUMNS, {}, ["_c0", *TEXT_COLUMNS, "Recovered"]).select(
        "source_file", *TEXT_COLUMNS
    )


@report(
    "SELECT DISTINCT strftime(day, '%m-%d-%Y') || '.csv' AS file_name, 'new' AS layout FROM event_days",
    EVENT_CASES,
)
def land_new_reports(spark, sf_dir):
    """Land three days by date, then all reports that are still missing, from a source folder."""
    source = land_event_reports(spark, sf_dir, scratch_path(spark, "source"))
    landing = Landing(scratch_path(spark, "landing"))
    if land_cases(spark, source.root, landing, dates=("2024-01-05", "2024-01-07")) != 3:
        raise RuntimeError("three days were asked for")
    land_cases(spark, source.root, landing)
    return case_files(spark, landing).select("file_name", "layout").distinct()
