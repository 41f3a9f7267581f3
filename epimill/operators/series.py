"""Row-ordered window operators over one series per key.

Every function takes the key columns and the column that orders a series. Frames
count rows, not days: a missing day is not filled in. Inputs hold one row per key
and day, so a series is as long as the calendar, however many source rows were
summed into it. Functions over the same key and order share one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from epimill.functions.numbers import zero_if_null

# Within a block weights fade to this share, far inside the range of a double.
SMALLEST_WEIGHT = 1e-18


def ordered(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def running_sum(value: Column, keys: Sequence[str], order: str) -> Column:
    return F.sum(value).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def delta(value: Column, keys: Sequence[str], order: str) -> Column:
    """Change from the row before; 0 for the first row and where either is null."""
    return zero_if_null(value - F.lag(value).over(ordered(keys, order)))


def null_if_negative(value: Column) -> Column:
    return F.when(value >= 0, value)


def rolling_mean(
    value: Column, keys: Sequence[str], order: str, rows: int = 7, min_rows: int = 1
) -> Column:
    """Mean of the last rows, nulls skipped; null with fewer than ``min_rows`` values."""
    frame = ordered(keys, order).rowsBetween(1 - rows, 0)
    mean = F.avg(value).over(frame)
    return mean if min_rows <= 1 else F.when(F.count(value).over(frame) >= min_rows, mean)


def add_ewm_means(
    df: DataFrame, means: dict[str, str], keys: Sequence[str], order: str, alpha: float = 0.2
) -> DataFrame:
    """Exponentially weighted means of all rows so far, as new name → value column.

    A row n places back has weight ``(1 - alpha) ** n``; a null keeps its place but
    has no weight, and where all newer rows are null the last mean stays. Each series
    is cut into blocks so short that weights inside one stay in the range of a double, and
    so long that a block's fading is below a double's precision. What lies before a block
    thus follows from the last two blocks with values before it: a third would weigh less
    than the rounding of the last. Every step is a window over the same rows in one order,
    so time grows with the series.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    so_far = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    if alpha == 1:
        last = {name: F.last(F.col(value).cast("double"), ignorenulls=True).over(so_far) for name, value in means.items()}
        return df.withColumns(last)
    keep = F.lit(1.0 - alpha)
    length = max(1, math.ceil(math.log(SMALLEST_WEIGHT) / math.log(1.0 - alpha)))
    rows = df.withColumn("_row", F.row_number().over(ordered(keys, order)) - 1)
    rows = rows.withColumns(
        {"_block": F.floor(F.col("_row") / length), "_place": F.pmod(F.col("_row"), F.lit(length)).cast("int")}
    )
    in_block = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    whole_block = Window.partitionBy(*keys, "_block")
    blocks_before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    growth = F.pow(keep, -F.col("_place"))
    at_end = F.pow(keep, F.lit(length - 1))

    def faded(weight: Column, blocks: Column) -> Column:
        return weight * F.pow(keep, F.lit(length) * blocks)

    entries, states, sums = {}, {}, {}
    for name, value in means.items():
        present = F.col(value).isNotNull()
        weighted = F.when(present, F.col(value).cast("double") * growth).otherwise(0.0)
        weights = F.when(present, growth).otherwise(0.0)
        sums[name] = weighted, weights
        block = F.struct(
            F.col("_block").alias("block"),
            (F.sum(weighted).over(whole_block) * at_end).alias("total"),
            (F.sum(weights).over(whole_block) * at_end).alias("weight"),
        )
        # one entry per block with values, at its first row
        entries[f"_block_of_{name}"] = F.when(F.col("_place") == 0, block)
    rows = rows.withColumns(entries)
    rows = rows.withColumns({entry: F.when(F.col(f"{entry}.weight") > 0, F.col(entry)) for entry in entries})
    last_block = {f"_last{entry}": F.last(entry, ignorenulls=True).over(blocks_before) for entry in entries}
    rows = rows.withColumns(last_block)
    for entry in entries:
        own, older = F.col(entry), F.col(f"_last{entry}")
        gap = own["block"] - older["block"]
        weight = own["weight"] + F.coalesce(faded(older["weight"], gap), F.lit(0.0))
        total = own["total"] + F.coalesce(faded(older["total"], gap), F.lit(0.0))
        state = F.struct(own["block"].alias("block"), (total / weight).alias("mean"), weight.alias("weight"))
        states[f"_state{entry}"] = F.when(own.isNotNull(), state)
    rows = rows.withColumns(states)
    rows = rows.withColumns({f"_before{state}": F.last(state, ignorenulls=True).over(blocks_before) for state in states})

    columns = {}
    for name in means:
        old = F.col(f"_before_state_block_of_{name}")
        fade = F.pow(keep, F.col("_place"))
        total, weight = (F.sum(part).over(in_block) * fade for part in sums[name])
        old_weight = F.coalesce(faded(old["weight"], F.col("_block") - 1 - old["block"]), F.lit(0.0)) * fade * keep
        both = (old_weight * F.coalesce(old["mean"], F.lit(0.0)) + total) / (old_weight + weight)
        columns[name] = F.when(weight == 0, old["mean"]).otherwise(both)
    made = rows.withColumns(columns)
    return made.select(*df.columns, *[name for name in means if name not in df.columns])


def is_outlier(value: Column, smooth: Column, factor: float = 2.0, threshold: float = 10000.0) -> Column:
    """Far above its smoothed value and large in itself; never null."""
    size = F.abs(value)
    return F.coalesce((size > F.abs(smooth * factor)) & (size > threshold), F.lit(False))


def drop_outliers(
    df: DataFrame, checks: Sequence[tuple[str, str]], factor: float = 2.0, threshold: float = 10000.0
) -> DataFrame:
    """Drop rows that are outliers in any of the (value, smoothed value) pairs."""
    keep = F.lit(True)
    for value, smooth in checks:
        keep = keep & ~is_outlier(F.col(value), F.col(smooth), factor, threshold)
    return df.where(keep)


def latest_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows at the latest date of their key; ties are kept."""
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.rank().over(window)).where("_rank = 1").drop("_rank")


def last_row(df: DataFrame, keys: Sequence[str], order: str, *tie_breakers: str) -> DataFrame:
    """One row per key, the last in order."""
    columns = [F.col(name).desc() for name in (order, *tie_breakers)]
    window = Window.partitionBy(*keys).orderBy(*columns)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")
