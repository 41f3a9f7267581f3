"""A Merkle manifest of a table: leaf places by bitmap ranks, levels by keyed slot arrays.

A group's leaves ascend by an integer id. Which ids a group has is kept in compressed bitmaps
of ``1 << BITS`` ids; a directory holds how many leaves lie before each bitmap and, inside it,
before each word of 64 bits. The place of a leaf is one look into the directory and a count
of bits, so leaves are not sorted. With its place a leaf goes to a slot of a keyed array; a
task turns an array of ``FAN_OUT ** levels`` slots into one node, and the nodes are the next
round's leaves. Proofs are put together from the root down, in the same arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epimill.llm.common import grouped, n_partitions, stored

FAN_OUT = 3
LEVELS = 6
BITS = 12
NAMES_PER_PART = 1 << 20
SUPER_BITS = 10
SLICE = 500
WORDS = (1 << BITS) // 64
NULL_BUCKET = -(1 << 62)
HASHES = "array<array<string>>"


def digest_of(columns: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the values, each as ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    texts = [c.cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told), 256)


def fold(leaf: Column, proof: Column, places: Column) -> Column:
    """The root that a leaf gives with its proof: at each level the run's digests, hashed in order."""

    def up(node: Column, step: Column) -> Column:
        place, others = step["places"], step["proof"]
        before, after = F.slice(others, 1, place), F.slice(others, place + 1, F.greatest(F.size(others) - place, F.lit(0)))
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(after, "")), 256)

    return F.aggregate(F.arrays_zip(proof.alias("proof"), places.alias("places")), leaf, up)


def _hash(run: Sequence[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def _levels(nodes: list[str], n: int, levels: int) -> list[list[str]]:
    """The nodes of a slot array and the levels above them; ``n`` nodes are in the whole group."""
    found = [nodes]
    whole = n <= FAN_OUT**levels
    while len(found[-1]) > 1 if whole else len(found) <= levels:
        last = found[-1]
        found.append([_hash(last[i : i + FAN_OUT]) for i in range(0, len(last), FAN_OUT)])
    return found


def _slots(rows: pa.Table, size: int) -> np.ndarray:
    """Row number for each slot of an array, by place."""
    slot = np.asarray(rows.column("place")) % size
    order = np.empty(len(slot), np.int64)
    order[slot] = np.arange(len(slot))
    return order


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """(group, place, n, node): the nodes ``levels`` above, or a group's last one."""
    size = FAN_OUT**levels
    names = ["group", "place", "n", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for (group, block), rows in grouped(batches, "group", "block"):
            n = rows.column("n")[0].as_py()
            own = rows.column("node").take(pa.array(_slots(rows, size))).to_pylist()
            made.append((group, block, -(-n // size), _levels(own, n, levels)[-1][0]))
            if len(made) >= SLICE:
                yield flushed()
                made = []
        if made:
            yield flushed()

    keyed = nodes.select("group", F.floor(F.col("place") / size).cast("long").alias("block"), "place", "n", "node")
    dealt = keyed.repartition("group", "block").sortWithinPartitions("group", "block")
    return dealt.mapInArrow(run, "group string, place long, n long, node string")


def with_paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with (proof, places), from those of the nodes ``levels`` above.

    proof: the digests beside the node at each level up to the root; places: how many of them
    stand before it. An array of slots and its node's path meet in one task.
    """
    size = FAN_OUT**levels
    block = F.floor(F.col("place") / size).cast("long").alias("block")
    path = above.select("group", F.col("place").alias("block"), F.lit(True).alias("is_path"), "proof", "places")
    both = nodes.select("*", block, F.lit(False).alias("is_path")).unionByName(path, allowMissingColumns=True)
    dealt = both.repartition("group", "block").sortWithinPartitions("group", "block", F.desc("is_path"))
    kept = nodes.columns
    schema = T.StructType([*nodes.schema.fields, *above.select("proof", "places").schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "group", "block"):
            upper, upper_places = rows.column("proof")[0].as_py(), rows.column("places")[0].as_py()
            rows = rows.slice(1).select(kept)
            if not rows.num_rows:
                continue
            rows = rows.take(pa.array(_slots(rows, size))).combine_chunks()
            found = _levels(rows.column("node").to_pylist(), rows.column("n")[0].as_py(), levels)[:-1]
            for at in range(0, rows.num_rows, SLICE):
                part = rows.slice(at, SLICE)
                proofs, places = [], []
                for i in range(at, at + part.num_rows):
                    proof, own = [], []
                    for level in found:
                        place = i % FAN_OUT
                        i //= FAN_OUT
                        run_of = level[i * FAN_OUT : (i + 1) * FAN_OUT]
                        proof.append(run_of[:place] + run_of[place + 1 :])
                        own.append(place)
                    proofs.append(proof + upper)
                    places.append(own + upper_places)
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                columns += [pa.array(proofs, pa.list_(pa.list_(pa.string()))), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return dealt.mapInArrow(run, schema)


def _reduced(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """The nodes of each round, from the given ones to one node for each group."""
    rounds = [nodes]
    most = nodes.select(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(stored(tops(rounds[-1], levels), name))
        most = -(-most // FAN_OUT**levels)
    return rounds


def _unpacked(container: bytes) -> np.ndarray:
    """The bitmap of a container as 64-bit words; one that is shorter than a bitmap lists its ids."""
    if len(container) == 8 * WORDS:
        return np.frombuffer(container, "<u8")
    bits = np.zeros(1 << BITS, np.uint8)
    bits[np.frombuffer(container, "<u2")] = 1
    return np.frombuffer(np.packbits(bits, bitorder="little").tobytes(), "<u8")


def _packed(ids: np.ndarray) -> bytes:
    if 2 * len(ids) < 8 * WORDS:
        return ids.astype("<u2").tobytes()
    bits = np.zeros(1 << BITS, np.uint8)
    bits[ids] = 1
    return np.packbits(bits, bitorder="little").tobytes()


CONTAINER = "group string, bucket long, container binary, more_ids binary, more binary, leaves long"


def containers(leaves: DataFrame) -> DataFrame:
    """(group, bucket, container, more_ids, more, leaves): the ids of a group as compressed bitmaps.

    Each task packs the ids it has; the packed ones of a bucket are merged. An id on several
    rows has one bit; ``more_ids`` and ``more`` say how many leaves it has beyond one.
    """
    names = [c.split()[0] for c in CONTAINER.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

    def packed(group: str, bucket: int, counts: np.ndarray) -> tuple:
        more = np.flatnonzero(counts > 1)
        extra = (counts[more] - 1).astype("<i8")
        return group, bucket, _packed(np.flatnonzero(counts)), more.astype("<u2").tobytes(), extra.tobytes(), int(counts.sum())

    def batches_of(made: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in made:
            held.append(row)
            if len(held) >= SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (group, bucket), rows in grouped(batches, "group", "bucket"):
                counts = np.zeros(1 << BITS, np.int64)
                np.add.at(counts, np.asarray(rows.column("offset")), np.asarray(rows.column("copies")))
                yield packed(group, bucket, counts)

        return batches_of(made())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (group, bucket), rows in grouped(batches, "group", "bucket"):
                counts = np.zeros(1 << BITS, np.int64)
                for bits, ids, more in zip(*(rows.column(c).to_pylist() for c in ("container", "more_ids", "more")), strict=True):
                    counts += np.unpackbits(np.frombuffer(_unpacked(bits).tobytes(), np.uint8), bitorder="little")
                    counts[np.frombuffer(ids, "<u2")] += np.frombuffer(more, "<i8")
                yield packed(group, bucket, counts)

        return batches_of(made())

    own = leaves.select("group", "bucket", "offset", "copies").sortWithinPartitions("group", "bucket")
    parts = own.mapInArrow(pack, CONTAINER)
    return parts.repartition("group", "bucket").sortWithinPartitions("group", "bucket").mapInArrow(merge, CONTAINER)


def with_directory(found: DataFrame) -> DataFrame:
    """Containers with ``before``, the leaves of their group in lower buckets, and ``n``, all of them.

    Buckets are summed in runs first, so no window holds all buckets of a group.
    """
    runs = found.withColumn("run", F.shiftright("bucket", SUPER_BITS))
    earlier = W.partitionBy("group").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    totals = runs.groupBy("group", "run").agg(F.sum("leaves").alias("in_run"))
    totals = totals.select(
        "group",
        "run",
        F.coalesce(F.sum("in_run").over(earlier), F.lit(0)).alias("before_run"),
        F.sum("in_run").over(W.partitionBy("group")).alias("n"),
    )
    inside = W.partitionBy("group", "run").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("leaves").over(inside), F.lit(0)) + F.col("before_run")
    joined = runs.join(totals, ["group", "run"])
    return joined.select("group", "bucket", "container", "more_ids", "more", before.alias("before"), "n")


def with_ranks(leaves: DataFrame, directory: DataFrame) -> DataFrame:
    """``leaves`` with (place, n): the place of each row's first leaf in its group, by ranks in the bitmaps."""
    ids = directory.withColumn("is_map", F.lit(True))
    both = leaves.withColumn("is_map", F.lit(False)).unionByName(ids, allowMissingColumns=True)
    dealt = both.repartition("group", "bucket").sortWithinPartitions("group", "bucket", F.desc("is_map"))
    kept = leaves.columns
    schema = T.StructType([*leaves.schema.fields, T.StructField("place", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "group", "bucket"):
            row = rows.slice(0, 1).to_pylist()[0]
            words = _unpacked(row["container"])
            popcounts = np.bitwise_count(words).astype(np.int64)
            before_word = np.cumsum(popcounts) - popcounts  # the directory inside the bitmap
            more_ids = np.frombuffer(row["more_ids"], "<u2")
            more_before = np.concatenate([[0], np.cumsum(np.frombuffer(row["more"], "<i8"))])
            rows = rows.slice(1).select(kept).combine_chunks()
            offset = np.asarray(rows.column("offset")).astype(np.int64)
            lower = (np.uint64(1) << (offset & 63).astype(np.uint64)) - np.uint64(1)
            rank = before_word[offset >> 6] + np.bitwise_count(words[offset >> 6] & lower)
            rank = rank + more_before[np.searchsorted(more_ids, offset)]
            shared = np.flatnonzero(np.isin(offset, more_ids))
            if len(shared):  # rows with one id lie in the order of their leaves
                leaf = np.array(rows.column("leaf").take(pa.array(shared)).to_pylist())
                copies = np.asarray(rows.column("copies"))[shared]
                order = np.lexsort((leaf, offset[shared]))
                own, size = offset[shared][order], copies[order]
                ahead = np.cumsum(size) - size
                first = np.r_[True, own[1:] != own[:-1]]
                rank[shared[order]] += ahead - np.maximum.accumulate(np.where(first, ahead, 0))
            place = pa.array(rank + row["before"])
            total = pa.array(np.full(len(rank), row["n"], np.int64))
            yield from rows.append_column("place", place).append_column("n", total).to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, schema)


def in_order(names: DataFrame, name: str) -> DataFrame:
    """Distinct texts with their place in byte order: parts of the order, then places inside each."""
    parts = n_partitions(names.sparkSession, names.count(), NAMES_PER_PART)
    dealt = names.repartitionByRange(parts, name).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "names")
    sizes = dealt.groupBy("part").count()
    earlier = F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("count").over(W.partitionBy()).alias("n"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(name)) - 1
    return dealt.join(sizes, "part").select(*names.columns, (inside + F.col("before")).cast("long").alias("place"), "n")


def manifest(
    leaves: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    leaf: str = "leaf",
    carry: Sequence[str] = (),
    levels: int = LEVELS,
) -> DataFrame:
    """(key, group, leaf, carry..., place, n, subroot, root, proof, places) for each row of ``leaves``.

    The leaves of a group ascend by key. Every ``FAN_OUT`` consecutive nodes of a level, the
    last run fewer, become the digest of their digests, until one is left, the subroot; a lone
    leaf is its own. The subroots, ordered by group (null first, then by bytes), likewise give
    the root. ``proof`` has the digests beside a row's node, level by level from its leaf to
    the root, ``places`` how many of them stand before it; ``fold`` gives the root again.

    A null key comes first. Rows with equal keys lie in the order of their leaves. Rows that
    repeat in all these columns are counted before they are moved, and each is a leaf; a hot
    group is dealt out by its ids. Columns beyond those named are left out. An empty table
    gives an empty manifest.
    """
    known = F.col(f"`{key}`").cast("long")
    bucket, offset = F.shiftright(known, BITS), known.bitwiseAND(F.lit((1 << BITS) - 1))
    rows = leaves.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("group"),
        F.coalesce(bucket, F.lit(NULL_BUCKET)).alias("bucket"),
        F.coalesce(offset, F.lit(0)).cast("int").alias("offset"),
        F.col(f"`{leaf}`").alias("leaf"),
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate((key, group, *carry))]).alias("row"),
    )
    rows = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "leaves", compression="zstd")
    found = stored(containers(rows), "containers")
    ranked = with_ranks(rows, with_directory(found))
    each = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    placed = ranked.select("*", each).select("group", (F.col("place") + F.col("copy")).alias("place"), "n", F.col("leaf").alias("node"), "row")
    placed = stored(placed, "places", compression="zstd")

    rounds = _reduced(placed.select("group", "place", "n", "node"), levels, "nodes")
    subroots = rounds[-1].select("group", "node")
    ordered = stored(in_order(subroots, "group").withColumnRenamed("group", "name").withColumn("group", F.lit("")), "subroots")
    upper = _reduced(ordered.select("group", "place", "n", "node"), levels, "upper-nodes")
    none = [F.array().cast(HASHES).alias("proof"), F.array().cast("array<int>").alias("places")]
    path = upper[-1].select("group", "place", *none)
    for nodes in reversed(upper[1:-1]):
        path = with_paths(nodes, path, levels)
    named = ordered.select("group", "place", "n", "node", "name")
    path = with_paths(named, path, levels) if len(upper) > 1 else named.select("*", *none)
    root = F.lit(upper[-1].select(F.first("node")).first()[0]).cast("string")
    tree = path.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("place"), F.col("node").alias("subroot"), "proof", "places")
    tree = stored(tree, "subroot-paths")
    path = tree
    for nodes in reversed(rounds[1:-1]):
        path = with_paths(nodes, path, levels)
    if len(rounds) > 1:
        made = with_paths(placed, path, levels)
    else:
        made = placed.join(tree.select("group", "proof", "places"), "group")
    made = made.join(tree.select("group", "subroot"), "group")
    named = [F.col(f"row.c{i}").alias(c) for i, c in enumerate((key, group, *carry))]
    return made.select(*named, F.col("node").alias(leaf), "place", "n", "subroot", root.alias("root"), "proof", "places")
