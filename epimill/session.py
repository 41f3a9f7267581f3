"""Session settings and the shared scratch folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


# Bytes a shuffle partition may hold before AQE merges small ones: few enough to be
# sorted in a task's memory, many enough to keep the number of shuffle blocks low.
SHUFFLE_PARTITION_BYTES = 512 * 1024**2
DEFAULT_SHUFFLE_PARTITIONS = 200


def shuffle_partitions(shuffle_bytes: float) -> int:
    """Partitions a shuffle of that size should start with."""
    return max(DEFAULT_SHUFFLE_PARTITIONS, math.ceil(shuffle_bytes / SHUFFLE_PARTITION_BYTES))


def get_session(
    app_name: str = "epimill", master: str | None = None, shuffle_bytes: float | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the operators assume.

    UTC keeps timestamp text stable in both directions. AQE re-plans joins from
    measured sizes, coalesces small partitions and splits skewed ones. Where every
    partition of one side is small, it may hash that side and so leave the other
    unsorted. AQE merges partitions but does not add any, so a large application
    names the bytes of its largest shuffle.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        **conf,
    }
    if shuffle_bytes:
        initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
        settings.setdefault(initial, str(shuffle_partitions(shuffle_bytes)))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: there the driver is
    the only machine. On a cluster an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="epimill-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never handed out twice."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def local_table(spark: SparkSession, **columns: list[str]) -> DataFrame:
    """A small table of text columns given as lists.

    Built from Arrow, which keeps its size known to the optimizer, so that a join
    with it is planned as a broadcast only as long as it is in fact small.
    """
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.string()) for name, values in columns.items()}))
