"""CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, functions as F

from epimill.sources.csv_files import ROW_INDEX
from epimill.sources.files import REPORT_COLUMN


def write_csv(df: DataFrame, path: str) -> None:
    """Write rows as CSV with a leading row index.

    The index grows in row order but has gaps: numbering without gaps would need
    all rows in one task.
    """
    csv_writer(df.select(F.monotonically_increasing_id().alias(ROW_INDEX), "*")).csv(path)


def write_reports(df: DataFrame, folder: str, report: str = REPORT_COLUMN) -> None:
    """Write rows as one CSV report per name in the ``report`` column.

    A report becomes a folder of part files with its name; a report that exists is
    replaced, others stay. Its rows meet in few tasks, and AQE splits a report that
    is large.
    """
    rows = df.withColumnRenamed(report, REPORT_COLUMN)
    rows = rows.select(F.monotonically_increasing_id().alias(ROW_INDEX), "*").hint("rebalance", REPORT_COLUMN)
    writer = csv_writer(rows).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").partitionBy(REPORT_COLUMN).csv(folder)


def add_parts(df: DataFrame, folder: str, report: str = REPORT_COLUMN, index: str = ROW_INDEX) -> None:
    """Add part files to the reports named in the ``report`` column; ``index`` places their rows."""
    rows = df.withColumnsRenamed({report: REPORT_COLUMN, index: ROW_INDEX})
    rows = rows.select(ROW_INDEX, *[name for name in rows.columns if name != ROW_INDEX]).hint("rebalance", REPORT_COLUMN)
    csv_writer(rows).mode("append").partitionBy(REPORT_COLUMN).csv(folder)


def csv_writer(df: DataFrame) -> DataFrameWriter:
    return df.write.option("header", "true").option("escape", '"').option("emptyValue", "")
