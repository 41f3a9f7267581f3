"""Exact top-k by inner product with a three-phase uniform threshold.

A vector is cut into ``NODES`` runs of dimensions; each run gives a list of partial scores,
and a score is the sum over the lists. First each list's best entries are gathered with
their full scores, and the k-th best of them is a safe cutoff: the answers score no less.
A vector whose partial scores are all below cutoff / NODES cannot reach it, so, secondly,
only entries at that uniform threshold are collected; thirdly, their scores are resolved
over all lists, and what reaches the cutoff is ranked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epimill.llm.common import stored

NODES = 2
SCALE = 256
ROWS_PER_BLOCK = 1 << 14
QUERIES_PER_BLOCK = 1 << 10
CHUNK = 1 << 11
EXACT = float(1 << 53)


def usable_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors whose components are all finite numbers, scaled and rounded down."""
    column = F.col(f"`{vector}`")
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    chosen = vectors.filter(F.col(f"`{key}`").isNotNull() & column.isNotNull()).filter(finite)
    return chosen.select(
        F.col(f"`{key}`").alias("vec_id"),
        # a double holds the whole number exactly; floor() would make a long, which may overflow
        F.transform(column, lambda x: _floor(x.cast("double") * SCALE)).alias("v"),
    )


def _floor(x: Column) -> Column:
    big = F.abs(x) >= float(1 << 52)
    return F.when(big, x).otherwise(F.floor(F.when(big, F.lit(0.0)).otherwise(x)).cast("double"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, the shorter ones filled with zeros."""
    flat = column.combine_chunks()
    if not len(flat):
        return np.zeros((0, width))
    lengths = np.diff(np.asarray(flat.offsets))
    values = np.asarray(flat.flatten())
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _partials(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Partial scores of all pairs for each run of dimensions, as exact whole numbers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= EXACT:
        q, x = (np.vectorize(int, otypes=[object])(m) for m in (q, x))
    cuts = np.linspace(0, q.shape[1], NODES + 1).astype(int)
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)]


def _best(n_queries: int, who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best entries; ties go to the smaller id."""
    order = np.lexsort((ids, -scores, who))
    first = np.searchsorted(who[order], np.arange(n_queries))
    return order[np.arange(len(order)) - first[who[order]] < k]


def _per_block(phase: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        vectors = queries.column("query_v"), rows.column("row_v")
        width = max(1, *(int(np.diff(np.asarray(v.combine_chunks().offsets)).max()) for v in vectors))
        q, x = (_matrix(v, width) for v in vectors)
        query_id, vec_id = np.asarray(queries.column("query_id")), np.asarray(rows.column("row_id"))
        if phase > 1:
            has_cutoff = np.asarray(queries.column("cutoff").is_valid())
            cutoff = np.asarray(queries.column("cutoff").fill_null(0))
        who, ids, scores = [], [], []
        for at in range(0, len(x), CHUNK):
            partial = _partials(q, x[at : at + CHUNK])
            other = query_id[:, None] != vec_id[None, at : at + CHUNK]
            if phase == 1:
                chosen = np.zeros(other.shape, bool)
                for p in partial:
                    p = np.where(other, p, -np.inf)
                    top = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k]
                    np.put_along_axis(chosen, top, True, axis=1)
                chosen &= other
            else:
                chosen = other & ~has_cutoff[:, None]
                for p in partial:
                    chosen |= other & (p * NODES >= cutoff[:, None])
            i, j = np.nonzero(chosen)
            total = sum(p[i, j] for p in partial).astype(np.int64)
            if phase > 1:
                enough = ~has_cutoff[i] | (total >= cutoff[i])
                i, j, total = i[enough], j[enough], total[enough]
            who.append(i)
            ids.append(vec_id[at + j])
            scores.append(total)
            joined = [np.concatenate(c) for c in (who, ids, scores)]
            best = _best(len(q), *joined, k)
            who, ids, scores = ([c[best]] for c in joined)
        number = np.asarray(queries.column("query"))
        columns = [number[who[0]], query_id[who[0]], ids[0], scores[0]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors, all if there are fewer.

    Scores are whole numbers: the inner product of the vectors times 256, rounded down. Ties
    go to the smaller id. Rows with a null id or vector, or a component that is null or not
    finite take no part; a shorter vector, also an empty one, counts as filled with zeros. A row
    never answers a query of its own id. Rows that repeat an id are rows of their own, dealt to
    different blocks, and a query that repeats id and vector is asked once.

    Queries and rows meet in blocks of bounded size, each pair of blocks in a task; a task
    passes on k entries for each of its queries. Nothing is broadcast: the cutoffs travel
    with their queries.
    """
    usable = stored(usable_vectors(vectors, key, vector), "vectors")
    asked = usable.withColumnRenamed("vec_id", key).filter(is_query).withColumnRenamed(key, "vec_id").distinct()
    asked = asked.select(
        F.xxhash64("vec_id", "v").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("query_v")
    )
    n_rows, n_queries = usable.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n_rows // ROWS_PER_BLOCK)), max(1, -(-n_queries // QUERIES_PER_BLOCK))
    rows = usable.select(
        F.col("vec_id").alias("row_id"),
        F.col("v").alias("row_v"),
        # the vectors are stored, so a row's place in its split is the same when a task runs again
        F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(row_blocks)).cast("int").alias("row_block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
    )
    asked = asked.withColumn("query_block", F.pmod("query", F.lit(query_blocks)).cast("int"))
    schema = "query long, query_id long, vec_id long, score long"
    at = ["row_block", "query_block"]

    def in_blocks(queries: DataFrame, phase: int) -> DataFrame:
        spread = queries.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        return spread.groupBy(*at).cogroup(rows.groupBy(*at)).applyInArrow(_per_block(phase, k), schema)

    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    rank = F.row_number().over(best)
    gathered = in_blocks(asked, 1).withColumn("rank", rank).filter(F.col("rank") <= k)
    cutoffs = stored(gathered.filter(F.col("rank") == k).select("query", F.col("score").alias("cutoff")), "cutoffs")
    found = in_blocks(asked.join(cutoffs, "query", "left"), 2).withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
