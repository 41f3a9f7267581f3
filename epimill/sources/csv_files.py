"""CSV readers for report files whose header changes over time.

Spark binds CSV columns by position, so files with different headers must not be
read in one scan. The readers group files by their header line and union the
groups by name. Every column is read as text, which keeps leading zeros.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from epimill.schemas import RENAMES
from epimill.sources.files import report_name, report_path, smallest_part, unescape

ROW_INDEX = "_c0"
UNREAD = "_unread_row"


def header_groups(
    spark: SparkSession, paths: list[str], samples: list[str] | None = None
) -> list[tuple[list[str], list[str]]]:
    """Reports grouped by header line, as (column names, paths).

    The parts of a report share one header, so only its smallest part is read for
    it. The lists name reports, which the driver holds anyway; they do not grow with
    the rows. ``samples`` are these parts, if a manifest has told them already. A
    bulk load of large single files whose header is known should name the header
    instead.
    """
    if samples is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(paths)
        reports = files.groupBy(report_path(F.col("path")).alias("report")).agg(smallest_part())
        samples = [row["sample"] for row in reports.collect() if row["sample"]]
    if not samples:
        return []
    lines = spark.read.text(samples).select(
        report_path(scanned_path()).alias("report"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value"),
    )
    headers = (
        lines.where(F.col("block") == 0).groupBy("report").agg(F.min_by("value", "line").alias("header"))
    )
    groups: dict[str, list[str]] = {}
    for row in headers.collect():
        groups.setdefault(row["header"], []).append(row["report"])
    return [(column_names(header), sorted(reports)) for header, reports in sorted(groups.items())]


def scanned_path() -> Column:
    """Path of the file a row comes from."""
    return unescape(F.col("_metadata.file_path"))


def column_names(header: str) -> list[str]:
    names = next(csv.reader([header.lstrip("\ufeff")]), [])
    return [name.strip() or f"_c{position}" for position, name in enumerate(names)]


def parsed_rows(
    spark: SparkSession, columns: list[str], paths: list[str], trusted: bool, multi_line: bool = False
) -> DataFrame:
    """All rows of reports that share one header, those that do not have its columns too.

    Such a row has its text in ``UNREAD``, which is null for the others. Spark would judge a row
    by the columns that are asked for, so that a row broken elsewhere passes; here it is
    parsed whole whatever is read of it. A report with another header stops the job, unless the
    header was read from the files themselves. ``scan_position`` is the place of a row among
    the parts of a report.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*columns, UNREAD]])
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", str(trusted).lower())
        .option("escape", '"')
        .option("multiLine", str(multi_line).lower())
        .option("columnPruning", "false")
        .option("columnNameOfCorruptRecord", UNREAD)
        .csv(paths)
        .select(
            "*",
            report_name(scanned_path()).alias("source_file"),
            F.struct(
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("scan_position"),
        )
    )


def read_group(
    spark: SparkSession, columns: list[str], paths: list[str], trusted: bool, multi_line: bool = False
) -> DataFrame:
    """Read reports that share one header; a row that does not have its columns stops the job.

    Mostly a quoted value goes on in the next line then, which ``multi_line`` reads, at the
    price of one task per file. The rows are looked at by a filter, which stays whatever
    columns are used later.
    """
    rows = parsed_rows(spark, columns, paths, trusted, multi_line)
    first = F.coalesce(F.col(f"`{columns[0]}`"), F.lit(""))  # Spark wants a column besides the unread text
    said = F.concat(
        F.lit("no row of its header in "), F.col("source_file"), F.lit(" (or read with multi_line): "),
        F.col(UNREAD), F.lit(" / "), first,
    )
    whole = F.when(F.col(UNREAD).isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True))
    return rows.where(whole).drop(UNREAD)


def broken_rows(
    spark: SparkSession, paths: list[str], header: list[str] | None = None, samples: list[str] | None = None
) -> DataFrame:
    """(source_file, text, scan_position) of the rows that do not have the columns of their report's header.

    A value that goes on in the next line gives two such rows; in the last column only the
    second of them lacks columns.
    """
    groups = [(list(header), paths)] if header else header_groups(spark, paths, samples)
    found = None
    for names, reports in groups:
        rows = parsed_rows(spark, names, reports, header is None)
        # the first column is named only because Spark wants one besides the unread text
        some = F.col(UNREAD).isNotNull() & (F.length(F.concat_ws("", UNREAD, F.col(f"`{names[0]}`"))) >= 0)
        rows = rows.where(some).select("source_file", F.col(UNREAD).alias("text"), "scan_position")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no CSV report with a header line among the given paths")
    return found


def read_csv_files(
    spark: SparkSession,
    paths: list[str],
    columns: list[str],
    renames: dict[str, str] | None = None,
    header: list[str] | None = None,
    samples: list[str] | None = None,
    required: Sequence[str] = (),
    multi_line: bool = False,
) -> DataFrame:
    """Read CSV reports of any header mix into the given columns plus lineage.

    A report that lacks a required column stops the load; other columns it lacks are
    null. ``source_file`` names the report and ``position`` orders its rows: by the
    stored row index if there is one, then by part, block of the part and line. With
    ``header``, all reports must have just that header.
    """
    wanted = [*columns, "source_file", "position"]
    groups = [(list(header), paths)] if header else header_groups(spark, paths, samples)
    parts = []
    for names, reports in groups:
        part = read_group(spark, names, reports, header is None, multi_line)
        part = rename_columns(part, RENAMES | (renames or {}))
        lacking = [name for name in required if name not in part.columns]
        if lacking:
            raise ValueError(f"without the columns {lacking}: {[path.rsplit('/', 1)[-1] for path in reports]}")
        index = F.col(ROW_INDEX).try_cast("bigint") if ROW_INDEX in names else F.lit(None).cast("bigint")
        part = part.withColumn("position", F.struct(index.alias("index"), "scan_position.*"))
        parts.append(part.select(*[name for name in wanted if name in part.columns]))
    if not parts:
        raise ValueError("no CSV report with a header line among the given paths")
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part, allowMissingColumns=True)
    # a column that no report has
    missing = {name: F.lit(None).cast("string") for name in wanted if name not in frame.columns}
    return frame.withColumns(missing).select(*wanted) if missing else frame.select(*wanted)


def rename_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in renames.items() if old in df.columns})
