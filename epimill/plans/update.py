"""Scheduled loads: daily cases, vaccinations and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from epimill.functions.dates import TIMESTAMP_TEXT
from epimill.operators.shape import STAMP_CORRECTIONS, correct_stamps, corrections_table
from epimill.plans import conform
from epimill.session import local_table
from epimill.sinks.warehouse import Warehouse
from epimill.sources.csv_files import read_csv_files
from epimill.sources.files import (
    REPORTS_PER_BATCH,
    by_report,
    choose_files,
    in_day_batches,
    list_files,
    read_batches,
    with_file_date,
)


@dataclass(frozen=True)
class Landing:
    """Where the source files are landed, below one root."""

    root: str
    # Folder and file names of the landing area.
    cases: str = "daily_case_data/"
    old_cases: str = "daily_case_data/old_format/"
    areas: str = "UID_ISO_FIPS_LookUp_Table.csv"
    vaccinations: str = "vaccination_data/country_data/"
    locations: str = "locations.csv"
    vaccination_totals: str = "vaccinations.csv"

    def path(self, part: str) -> str:
        return f"{self.root.rstrip('/')}/{part}"


def case_files(spark: SparkSession, landing: Landing) -> DataFrame:
    """Landed case files of both layouts."""
    new = list_files(spark, landing.path(landing.cases)).withColumn("layout", F.lit("new"))
    old = list_files(spark, landing.path(landing.old_cases)).withColumn("layout", F.lit("old"))
    return new.unionByName(old)


def load_cases(
    warehouse: Warehouse,
    landing: Landing,
    dates: tuple[str, ...] | None = None,
    process_all: bool = False,
    reload_country: str | None = None,
    corrections: Sequence[tuple[str, str, str, str]] = (),
    headers: dict[str, list[str]] | None = None,
    multi_line: bool = False,
    reports_per_batch: int = REPORTS_PER_BATCH,
) -> int:
    """Load daily reports into the case, time and ledger tables; returns the file count.

    Files already in the ledger are skipped unless dates are given or all files are
    asked for. With ``reload_country``, the stored rows of that country are deleted
    first (in the date range, if one is given) and only its rows are loaded, from all
    landed files of the range. Files that were not in the ledger stay out of it then, as
    the other countries' rows are still to be loaded.
    ``headers`` names the header of a layout where it is known to be the same in
    all files, which saves looking for header lines. A row that does not have its header's
    columns stops the load before anything of its batch is stored; ``multi_line`` reads quoted
    values that go on in the next line, with one task for each file.

    The reports are loaded in batches of whole days, oldest first, so that the driver never
    holds more names than those of ``reports_per_batch`` reports and a day. Each batch is
    booked when it is stored; a load that stops goes on with the next one when it is repeated.
    """
    process_all = process_all or reload_country is not None and not dates
    files = choose_files(
        case_files(warehouse.spark, landing), warehouse.read("csv_record"), "case", dates, process_all
    )
    return load_reports(
        warehouse, files, dates, reload_country, corrections, headers,
        multi_line=multi_line, reports_per_batch=reports_per_batch,
    )


def load_reports(
    warehouse: Warehouse,
    files: DataFrame,
    dates: tuple[str, ...] | None = None,
    reload_country: str | None = None,
    corrections: Sequence[tuple[str, str, str, str]] = (),
    headers: dict[str, list[str]] | None = None,
    replace_rows: bool = False,
    multi_line: bool = False,
    reports_per_batch: int = REPORTS_PER_BATCH,
) -> int:
    """Load the case reports that a manifest with layouts names, each of them whole.

    With ``replace_rows``, a stored row gives way as a whole to the report's row of its
    key; otherwise its counts are updated and its stamp stays. The manifest is stored
    first: what the ledger or the folder says later does not change a load under way.
    """
    spark = warehouse.spark
    with warehouse.staged(with_file_date(by_report(files, "layout")), "files") as listed:
        undated = listed.where("file_date is null").select("file_name").orderBy("file_name").limit(10).collect()
        if undated:
            raise ValueError(f"no report date in file names: {[row['file_name'] for row in undated]}")
        n_reports, n_readable = listed.agg(F.count("*"), F.count("sample")).first()
        if n_reports and not n_readable:
            raise ValueError("the case files are empty, without even a header")
        first, last = (dates[0], dates[-1]) if dates else (None, None)
        done = 0
        for chosen in read_batches(in_day_batches(listed, reports_per_batch)):
            done += len(chosen)
            latest = max(row["file_date"] for row in chosen)
            rows = read_cases(spark, chosen, corrections, headers or {}, multi_line)
            # the days between two batches belong to the later one
            days = (first, last if done == n_reports else latest)
            store_cases(warehouse, rows, days, reload_country, replace_rows)
            first = latest + timedelta(days=1)
            names = names_of(warehouse, chosen)
            if reload_country is not None:
                known = warehouse.read("csv_record").where("data_type = 'case'").select("file_name")
                names = names.join(known, "file_name", "left_semi")
            record_files(warehouse, names, "case")
    return n_reports


def read_cases(
    spark: SparkSession,
    chosen: Sequence[Row],
    corrections: Sequence[tuple[str, str, str, str]],
    headers: dict[str, list[str]],
    multi_line: bool,
) -> DataFrame:
    """Conformed rows of reports of both layouts, with corrected stamps; none if all are empty files."""
    raw = None
    for layout in ("new", "old"):
        reports = [row for row in chosen if row["layout"] == layout and row["sample"]]
        if reports:
            part = read_reports(
                spark, reports, conform.CASE_COLUMNS, conform.CASE_REQUIRED, headers.get(layout), multi_line
            )
            part = part.withColumn("layout", F.lit(layout))
            raw = part if raw is None else raw.unionByName(part)
    if raw is None:
        texts = ", ".join(f"{name} string" for name in [*conform.CASE_COLUMNS, *conform.LINEAGE])
        raw = spark.createDataFrame([], texts)
    rows = conform.conform_cases(raw)
    return correct_stamps(rows, corrections_table(spark, corrections)) if corrections else rows


def store_cases(
    warehouse: Warehouse,
    rows: DataFrame,
    days: tuple[object, object],
    reload_country: str | None,
    replace_rows: bool,
) -> None:
    """Store conformed rows; a reload first deletes the country's rows of the days, ends included."""
    wanted = F.lit(True) if reload_country is None else F.col("country_region") == reload_country
    with warehouse.staged(rows, "cases") as stage:
        chosen_rows = stage.where(wanted)
        unique = conform.first_cases(chosen_rows)
        if reload_country is None:
            warehouse.upsert("daily_case", unique, chosen_rows, replace_rows)
        else:
            warehouse.replace("daily_case", unique, "date_case", *days, wanted)
        warehouse.insert_if_absent("dim_time", conform.time_rows(stage))


def load_vaccinations(warehouse: Warehouse, landing: Landing, process_all: bool = True) -> int:
    """Load the per-country files; they are rewritten at the source, so all by default."""
    files = list_files(warehouse.spark, landing.path(landing.vaccinations))
    chosen = choose_files(files, warehouse.read("csv_record"), "vac", None, process_all)
    chosen = by_report(chosen).collect()
    if not chosen:
        return 0
    raw = read_reports(warehouse.spark, [row for row in chosen if row["sample"]], conform.VAC_COLUMNS, conform.VAC_COLUMNS)
    with warehouse.staged(conform.conform_vaccinations(raw), "vac") as stage:
        warehouse.upsert("vac", conform.first_vaccinations(stage), stage)
    record_files(warehouse, names_of(warehouse, chosen), "vac")
    return len(chosen)


def load_lookup(warehouse: Warehouse, landing: Landing) -> None:
    spark = warehouse.spark
    areas, places = conform.AREA_COLUMNS, conform.LOCATION_COLUMNS
    areas = read_csv_files(spark, [landing.path(landing.areas)], areas, required=areas)
    locations = read_csv_files(spark, [landing.path(landing.locations)], places, required=places)
    warehouse.insert_if_absent("country_loc", conform.conform_lookup(areas, locations))


def read_reports(
    spark: SparkSession,
    reports: Sequence[Row],
    columns: list[str],
    required: Sequence[str] = (),
    header: list[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    paths = sorted(row["report_path"] for row in reports)
    samples = sorted(row["sample"] for row in reports)
    return read_csv_files(
        spark, paths, columns, header=header, samples=samples, required=required, multi_line=multi_line
    )


def read_vaccination_totals(
    spark: SparkSession, landing: Landing, columns: Sequence[str] = ("location", "date")
) -> DataFrame:
    """The aggregated vaccination file, as text; it must have the columns."""
    rows = read_csv_files(spark, [landing.path(landing.vaccination_totals)], list(columns), required=columns)
    return rows.select(*columns)


def names_of(warehouse: Warehouse, chosen: Sequence[Row]) -> DataFrame:
    return local_table(warehouse.spark, file_name=[row["file_name"] for row in chosen])


def record_files(warehouse: Warehouse, names: DataFrame, data_type: str) -> None:
    """Note the files in the ledger, after their rows are stored."""
    stamp = F.date_format(F.current_timestamp(), TIMESTAMP_TEXT)
    entries = names.select("file_name").distinct()
    warehouse.upsert(
        "csv_record",
        entries.withColumns({"last_update": stamp, "data_type": F.lit(data_type)}),
    )


def daily_update(warehouse: Warehouse, landing: Landing) -> dict[str, int]:
    """New case files, all vaccination files, and the lookups."""
    warehouse.create_tables()
    cases = load_cases(warehouse, landing, corrections=STAMP_CORRECTIONS)
    vaccinations = load_vaccinations(warehouse, landing)
    load_lookup(warehouse, landing)
    return {"case_files": cases, "vaccination_files": vaccinations}
