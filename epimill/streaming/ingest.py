"""Case reports as a file stream.

The checkpoint takes the place of the ledger lookup: each file is met once. The
stream only tells which reports have new files; every such report is then read
whole. A report whose parts arrive in several batches is therefore judged as one:
the first row of a key is the first of the report, not of a batch, and replaces as a
whole what an earlier batch has stored for the key. The result does not depend on
how the parts fall into batches, as long as a day comes in one layout.

A file rewritten under its old name is not met again, which suits daily reports but
not the vaccination files; those stay a batch reload.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epimill import schemas
from epimill.plans.update import Landing, load_reports
from epimill.sinks.warehouse import Warehouse
from epimill.sources.files import report_name, report_path, unescape

# Fixed value: the columns Spark gives for a file; the content is not read.
FILE_COLUMNS = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, folder: str, layout: str, max_files: int | None = None) -> DataFrame:
    """Stream of the CSV files of a folder's reports, as a manifest with their layout.

    ``max_files`` bounds a batch. Where reports are folders of many parts it is best
    left out, as a report is read again for each batch that holds one of its parts.
    """
    return _manifest(_files(spark, f"{folder.rstrip('/')}/*.csv", max_files), F.lit(layout))


def stream_landing(spark: SparkSession, landing: Landing, max_files: int | None = None) -> DataFrame:
    """One stream of the case files of both layouts, for one checkpoint; the layout follows from the folder."""
    both = ",".join(f"{folder.strip('/')}/*.csv" for folder in (landing.cases, landing.old_cases))
    files = _files(spark, f"{landing.root.rstrip('/')}/{{{both}}}", max_files)
    old = unescape(F.col("path")).contains(f"/{landing.old_cases.strip('/')}/")
    return _manifest(files, F.when(old, "old").otherwise("new"))


def _files(spark: SparkSession, pattern: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILE_COLUMNS).option("pathGlobFilter", "*.csv")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(pattern)


def _manifest(files: DataFrame, layout: Column) -> DataFrame:
    return files.select(
        "path",
        "length",
        report_path(F.col("path")).alias("report_path"),
        report_name(F.col("path")).alias("file_name"),
        layout.alias("layout"),
    )


def ingest_reports(
    warehouse: Warehouse,
    files: DataFrame,
    checkpoint: str,
    corrections: Sequence[tuple[str, str, str, str]] = (),
    headers: dict[str, list[str]] | None = None,
) -> int:
    """Load the reports of all files that are new since the last run; returns how many it loaded.

    A batch that is replayed after a failure finds its own rows by key, so each
    row is stored once. A report with files in several batches counts once for each.
    """
    database = warehouse.database
    loaded: list[int] = []

    def load(batch: DataFrame, batch_id: int) -> None:
        target = Warehouse(batch.sparkSession, database)
        loaded.append(load_reports(target, batch, corrections=corrections, headers=headers, replace_rows=True))

    query = (
        files.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # batches run in a session of their own; this one may know the files of before
    for table in schemas.TABLES:
        warehouse.spark.catalog.refreshTable(warehouse.name(table))
    return sum(loaded)
