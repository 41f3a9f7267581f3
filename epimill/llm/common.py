"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epimill.session import scratch_path


SLICE_ROWS = 500


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of those names; an operator's outputs take their place."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage, so that a lost executor costs a read, and lets Spark plan with
    the table's true size. The folder belongs to the application's scratch space.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession, total: float, each: float) -> int:
    """Parts of about ``each`` units, at least as many as a shuffle has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-total // each)))


def add_columns(
    df: DataFrame, columns: str, add: Callable[[pa.RecordBatch], list[pa.Array]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` with columns that ``add`` makes of each Arrow batch.

    columns: DDL of the new columns, which replace columns of the same names.
    drop: columns that ``add`` reads but the result leaves out.
    """
    made = T.StructType.fromDDL(columns)
    replaced = {m.name.lower() for m in made} | {d.lower() for d in drop}
    kept = T.StructType([f for f in df.schema.fields if f.name.lower() not in replaced])
    schema = T.StructType([*kept.fields, *[T.StructField(m.name, m.dataType) for m in made]])
    names, all_names = kept.names, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                new = add(batch)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *new], all_names)

    return df.mapInArrow(run, schema)


def list_of(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow list column cut from one flat array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def row_key(df: DataFrame) -> Column:
    """A hash of all columns, so that copies of a text under other ids fall apart."""
    usable = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*[F.col(f"`{c}`") for c in usable])


def new_id() -> str:
    return uuid.uuid4().hex


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) of each run of equal keys, over the borders of batches.

    For partitions sorted by these columns, which hold no nulls. One run is held at a time.
    """
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            column = batch.column(k)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(new).tolist()
        for a, b in zip(firsts, [*firsts[1:], batch.num_rows], strict=True):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if key != at:
                if held:
                    yield at, pa.Table.from_batches(held)
                at, held = key, []
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)
