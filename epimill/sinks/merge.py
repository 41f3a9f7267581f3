"""Merges of a batch into existing rows, as plain DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Target rows, with the update columns taken from the batch where a key matches,
    plus the batch rows with new keys.

    One shuffle of both sides on the key. Keys must be unique on each side, so no
    key can make a partition large. As with a unique index, a null key matches none.
    """
    new = batch.select(
        *[F.col(name).alias(f"_new_{name}") for name in target.columns], F.lit(True).alias("_in_batch")
    )
    old = target.withColumn("_in_target", F.lit(True))
    same = [F.col(name) == F.col(f"_new_{name}") for name in keys]
    both = old.join(new, same, "full")
    columns = []
    for name in target.columns:
        value = F.col(f"_new_{name}")
        source = F.col("_in_batch") if name in update else F.col("_in_target").isNull()
        columns.append(F.when(source, value).otherwise(F.col(name)).alias(name))
    return both.select(*columns)


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch rows whose key the target does not hold yet."""
    known = target.select(*[F.col(name).alias(f"_known_{name}") for name in keys])
    same = [F.col(name) == F.col(f"_known_{name}") for name in keys]
    return batch.join(known, same, "left_anti")


def replace_rows(target: DataFrame, batch: DataFrame, doomed: Column) -> DataFrame:
    """Target without the rows that meet a condition, plus the batch."""
    kept = target.where(~F.coalesce(doomed, F.lit(False)))
    return kept.unionByName(batch.select(*target.columns))
