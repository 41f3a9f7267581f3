"""The queries of this package, by name, and the SQL that checks them."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_SHIPPED: set[str] = set()
# Documents may be long: what goes to a Python worker at once is bounded in bytes.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "16m"


def ship_package(spark: SparkSession) -> None:
    """Send this library to the executors, once for each application, and bound what Arrow moves at once."""
    context = spark.sparkContext
    if context.getConf().get(BATCH_SETTING) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = Path(tempfile.mkdtemp(prefix="shipped-")).resolve()  # Spark serves the file from here
        chosen = folder / "tree"
        shutil.copytree(package, chosen / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", chosen))
        _SHIPPED.add(context.applicationId)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @wraps(function)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = shipped
        if oracle:
            ORACLES[name] = oracle
        return shipped

    return register
