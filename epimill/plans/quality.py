"""Reconciliation checks, each a DataFrame of violations (check, direction, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from epimill import schemas
from epimill.functions.dates import date_text, file_date
from epimill.functions.texts import first_part
from epimill.operators.groups import distinct_values, duplicate_keys, only_in_one, with_next_day
from epimill.operators.shape import area_level
from epimill.plans.conform import CASE_COLUMNS, VAC_COLUMNS
from epimill.plans.update import Landing, case_files, read_reports, read_vaccination_totals
from epimill.sinks.warehouse import Warehouse
from epimill.sources.csv_files import read_csv_files
from epimill.sources.files import by_report, list_files


def ledger_files(ledger: DataFrame, data_type: str) -> DataFrame:
    return ledger.where(F.col("data_type") == data_type).select("file_name")


def ledger_dates(ledger: DataFrame, next_day: bool = False) -> DataFrame:
    days = ledger_files(ledger, "case").select(file_date(F.col("file_name")).alias("day")).distinct()
    days = with_next_day(days, "day") if next_day else days
    return days.select(date_text(F.col("day")).alias("date_string"))


def both_ways(check: str, left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    found = only_in_one(left, right, left_name, right_name)
    return found.select(
        F.lit(check).alias("check"), F.concat(F.lit("only in "), "only_in").alias("direction"), "value"
    )


Gap = tuple[str, str, str]


def labelled(df: DataFrame, gaps: Sequence[Gap]) -> DataFrame:
    """Distinct values of several columns in one pass, as (check, direction, value).

    A gap is named by its check, the table that should hold the value, and a column.
    """
    cells = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(f"not in {table}").alias("direction"),
            F.col(column).cast("string").alias("value"),
        )
        for check, table, column in gaps
    ]
    return df.select(F.inline(F.array(*cells))).distinct()


def missing(source: DataFrame, gaps: Sequence[Gap], known: DataFrame) -> DataFrame:
    """Source values that the labelled known values lack. Both sides are reduced to
    distinct values before they meet; null is no value."""
    values = labelled(source, gaps).where(F.col("value").isNotNull())
    return values.join(known, ["check", "direction", "value"], "left_anti")


def check_files(files: DataFrame, ledger: DataFrame, data_type: str) -> DataFrame:
    """Files not processed yet, and ledger entries whose file is gone."""
    names = files.select("file_name")
    return both_ways(f"{data_type} files", names, ledger_files(ledger, data_type), "files", "csv_record")


def check_case_dates(ledger: DataFrame, daily_case: DataFrame, next_day: bool = False) -> DataFrame:
    stored = distinct_values(daily_case, "date_string")
    return both_ways("case dates", ledger_dates(ledger, next_day), stored, "csv_record", "daily_case")


def check_time_dates(ledger: DataFrame, dim_time: DataFrame, next_day: bool = False) -> DataFrame:
    stored = distinct_values(dim_time, "date_string")
    return both_ways("time dates", ledger_dates(ledger, next_day), stored, "csv_record", "dim_time")


def check_areas(areas: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Countries and provinces of the area lookup that a table lacks."""
    gaps = [("countries", name, "country_region"), ("provinces", name, "province_state")]
    return missing(areas, gaps, labelled(table, gaps))


def check_locations(locations: DataFrame, country_loc: DataFrame) -> DataFrame:
    gaps = [("locations", "country_loc", "location")]
    return missing(locations, gaps, labelled(country_loc, gaps))


def check_vaccinations(totals: DataFrame, vac: DataFrame, ledger: DataFrame) -> DataFrame:
    """Locations and dates of the all-countries file missing in the table or the ledger."""
    loaded = ledger_files(ledger, "vac").select(first_part(F.col("file_name"), ".").alias("location"))
    in_vac = labelled(vac, [("locations", "vac", "location"), ("dates", "vac", "date_string")])
    in_ledger = labelled(loaded, [("locations", "csv_record", "location")])
    gaps = [("locations", "vac", "location"), ("dates", "vac", "date"), ("locations", "csv_record", "location")]
    return missing(totals, gaps, in_vac.unionByName(in_ledger))


def check_unread_dates(vac: DataFrame) -> DataFrame:
    """Date texts of stored vaccination rows that are no date; such rows match no case day."""
    unread = vac.where(F.col("date_string").isNull()).select(F.col("date_org").alias("value")).distinct()
    return unread.select(F.lit("dates").alias("check"), F.lit("not a date").alias("direction"), "value")


def check_unreadable(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Texts of count columns that are no number; they are loaded as null."""
    texts = F.array(*[F.struct(F.lit(name).alias("direction"), F.col(name).alias("value")) for name in columns])
    found = raw.select(F.explode(texts).alias("found")).select("found.*")
    unread = (F.trim("value") != "") & F.col("value").try_cast("double").isNull()
    return found.where(unread).distinct().select(F.lit("unreadable count").alias("check"), "direction", "value")


def check_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys held by more than one row, as one text value."""
    return duplicate_keys(df, keys).select(
        F.lit("unique key").alias("check"), F.lit(name).alias("direction"), key_text(keys).alias("value")
    )


def check_fan_out(country_loc: DataFrame) -> DataFrame:
    """Countries with several rows at country level; each would multiply case rows."""
    whole = area_level(country_loc, "province_state", ["country_region"])
    return check_keys(whole, ["country_region"], "country_loc country level")


def check_all(warehouse: Warehouse, landing: Landing) -> DataFrame:
    """Every check over a loaded warehouse and its landed files; no rows means no findings."""
    spark = warehouse.spark
    ledger, daily_case, vac = (warehouse.read(name) for name in ("csv_record", "daily_case", "vac"))
    country_loc, dim_time = warehouse.read("country_loc"), warehouse.read("dim_time")
    areas = read_csv_files(spark, [landing.path(landing.areas)], ["Country_Region", "Province_State"])
    areas = areas.toDF(*[name.lower() for name in areas.columns])
    locations = read_csv_files(spark, [landing.path(landing.locations)], ["location"])
    totals = read_vaccination_totals(spark, landing)
    vac_files = list_files(spark, landing.path(landing.vaccinations))
    texts = [
        (case_files(spark, landing), CASE_COLUMNS, ["Confirmed", "Deaths", "Recovered", "Active"]),
        (vac_files, VAC_COLUMNS, schemas.VAC_MEASURES),
    ]
    counts = []
    for files, columns, measures in texts:
        reports = [row for row in by_report(files).collect() if row["sample"]]
        if reports:
            counts.append(check_unreadable(read_reports(spark, reports, columns), measures))
    checks = [
        *counts,
        check_files(case_files(spark, landing), ledger, "case"),
        check_files(vac_files, ledger, "vac"),
        check_case_dates(ledger, daily_case),
        check_time_dates(ledger, dim_time),
        check_areas(areas, daily_case, "daily_case"),
        check_areas(areas, country_loc, "country_loc"),
        check_locations(locations, country_loc),
        check_vaccinations(totals, vac, ledger),
        check_unread_dates(vac),
        check_fan_out(country_loc),
        *[check_keys(warehouse.read(name), keys, name) for name, keys in schemas.KEYS.items()],
    ]
    found = checks[0]
    for check in checks[1:]:
        found = found.unionByName(check)
    return found


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(name).cast("string"), F.lit("")) for name in keys])
