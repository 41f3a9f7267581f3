"""File manifests and the choice of files to ingest.

A manifest is a DataFrame with one row per file. It is made by Spark's own file
listing; the file contents are never read for it. A report may be a single CSV
file or, when it is large, a folder of part files that bears the report's name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from epimill.functions.dates import file_date, file_name_for
from epimill.functions.texts import contains_any

# First and last report date of the older header layout.
OLD_LAYOUT_FIRST = "2020-01-22"
OLD_LAYOUT_LAST = "2020-03-21"


MANIFEST = "path string, file_name string, report_path string, modification_time timestamp, length bigint"


REPORT_COLUMN = "report"

REPORTS_PER_BATCH = 10_000


def unescape(text: Column) -> Column:
    """Text without URL escapes; a plus sign in it is not an escape."""
    decoded = F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(text.contains("%"), decoded).otherwise(text)


def is_part(path: Column) -> Column:
    """Whether a file is one of the parts of a report folder."""
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.substring_index(path, "/", -1).startswith("part-") & folder.endswith(".csv")


def report_path(path: Column) -> Column:
    """The report a file belongs to: itself, or the folder whose part it is."""
    name_length = F.length(F.substring_index(path, "/", -1))
    folder = F.substring(path, F.lit(1), F.length(path) - name_length - 1)
    return F.when(is_part(path), folder).otherwise(path)


def report_name(path: Column) -> Column:
    """Name of the report a file belongs to.

    Runs for every row read, so it cuts at separators rather than match patterns.
    Folders that Spark names itself have a prefix, and some characters escaped.
    """
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    name = F.when(is_part(path), folder).otherwise(F.substring_index(path, "/", -1))
    prefix = f"{REPORT_COLUMN}="
    return F.when(name.startswith(prefix), unescape(F.substring_index(name, prefix, -1))).otherwise(name)


def list_files(
    spark: SparkSession, folder: str, name_glob: str = "*.csv", recursive: bool = False
) -> DataFrame:
    """CSV files of a folder: path, file_name, report_path, modification_time, length.

    Without ``recursive``, only the folder's own reports are listed. A folder
    without any is an empty manifest.
    """
    reader = spark.read.format("binaryFile")
    try:
        if recursive:
            reader = reader.option("pathGlobFilter", name_glob).option("recursiveFileLookup", "true")
            listing = reader.load(folder)
        else:
            listing = reader.option("pathGlobFilter", "*.csv").load(f"{folder.rstrip('/')}/{name_glob}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    return listing.select(
        "path",
        report_name(F.col("path")).alias("file_name"),
        report_path(F.col("path")).alias("report_path"),
        F.col("modificationTime").alias("modification_time"),
        "length",
    )


def smallest_part() -> Column:
    """Aggregate over the files of a report: path of its smallest file that has content."""
    length = F.when(F.col("length") > 0, F.col("length"))
    return F.min_by("path", length).alias("sample")


def by_report(files: DataFrame, *columns: str) -> DataFrame:
    """One row per report of a manifest, with its smallest part."""
    return files.groupBy("report_path", "file_name", *columns).agg(smallest_part())


def with_file_date(files: DataFrame, name: str = "file_name") -> DataFrame:
    return files.withColumn("file_date", file_date(F.col(name)))


def not_in_ledger(files: DataFrame, ledger: DataFrame, data_type: str) -> DataFrame:
    """Files without a ledger entry of the given type."""
    done = ledger.where(F.col("data_type") == data_type).select("file_name")
    return files.join(done, "file_name", "left_anti")


def not_landed(source: DataFrame, landed: DataFrame) -> DataFrame:
    """Files offered by a source that have not been landed yet."""
    return source.join(landed.select("file_name"), "file_name", "left_anti")


def dates_between(spark: SparkSession, first: str, last: str | None = None) -> DataFrame:
    """One row per day of an inclusive range; a single day when ``last`` is None."""
    bounds = F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last or first)))
    return spark.range(1).select(F.explode(bounds).alias("file_date"))


def names_between(spark: SparkSession, first: str, last: str | None = None) -> DataFrame:
    days = dates_between(spark, first, last)
    return days.select(file_name_for(F.col("file_date")).alias("file_name"))


def in_date_range(files: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """Files whose name carries a date of the inclusive range."""
    day = file_date(F.col("file_name"))
    return files.where(day.between(F.to_date(F.lit(first)), F.to_date(F.lit(last or first))))


def with_name_containing(files: DataFrame, needles: list[str]) -> DataFrame:
    return files.where(contains_any(F.col("file_name"), needles))


def with_layout(
    files: DataFrame, first: str = OLD_LAYOUT_FIRST, last: str = OLD_LAYOUT_LAST
) -> DataFrame:
    """Say whether a file has the older header layout, from the date in its name."""
    old = file_date(F.col("file_name")).between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    return files.withColumn("layout", F.when(old, "old").otherwise("new"))


def choose_files(
    files: DataFrame,
    ledger: DataFrame,
    data_type: str,
    dates: tuple[str, ...] | None = None,
    process_all: bool = False,
) -> DataFrame:
    """Files to ingest: those of given dates, or all, or those not in the ledger."""
    if dates:
        return in_date_range(files, dates[0], dates[-1])
    if process_all:
        return files
    return not_in_ledger(files, ledger, data_type)


def in_day_batches(reports: DataFrame, reports_per_batch: int = REPORTS_PER_BATCH) -> DataFrame:
    """Dated reports with their batch, from 0, in the order of days.

    A day is never cut, so a batch has less than ``reports_per_batch`` reports beside those of
    its last day. The running sum is over days, of which there are as many as in the calendar.
    """
    days = reports.groupBy("file_date").agg(F.count("*").alias("_reports"))
    before = F.sum("_reports").over(Window.orderBy("file_date")) - F.col("_reports")
    days = days.select("file_date", F.floor(before / reports_per_batch).alias("_batch"))
    # numbers without gaps, as a crowded day may skip some
    days = days.select("file_date", (F.dense_rank().over(Window.orderBy("_batch")) - 1).alias("batch"))
    return reports.join(days, "file_date")


def in_hash_batches(reports: DataFrame, reports_per_batch: int = REPORTS_PER_BATCH) -> DataFrame:
    """Reports with a batch by the hash of their name, for steps that take each name alone."""
    batches = max(1, -(-reports.count() // reports_per_batch))
    return reports.withColumn("batch", F.pmod(F.xxhash64("file_name"), F.lit(batches)).cast("int"))


def read_batches(manifest: DataFrame) -> Iterator[list[Row]]:
    """The reports of one batch after another, of a stored manifest; none of them is empty."""
    numbers = manifest.select("batch").distinct().orderBy("batch").collect()
    for (number,) in numbers:
        yield manifest.where(F.col("batch") == number).orderBy("report_path").collect()
