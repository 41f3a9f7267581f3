"""Near-duplicates by SimHash, with a hierarchical index over fingerprints in Gray order.

Two fingerprints that differ in at most d of their bits agree on one of d + 1 disjoint
masks. The upper nodes of the index are those masked patterns: each node holds the distinct
fingerprints that share one, and a node with too many has nodes of its own below it, by masks
over its other bits. Inside a lowest node they are sorted by Gray rank, in which neighbours
share most bits, and grouped level by level; a group keeps the bits that all members share.
Two groups whose shared bits already differ in more than d places are left out as a whole,
and the differences add up on the way down.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epimill.llm.common import add_columns, fresh, row_key, stored
from epimill.llm.graph import component_roots

BITS = 64
SEED = 42
NODE_LIMIT = 1 << 16
LEVELS = 2
FANOUT = 8
SMALL = 64
CHUNK_PAIRS = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and ASCII blanks count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def add_fingerprints(docs: DataFrame, shingle: int, text: str = "text", out: str = "simhash") -> DataFrame:
    """``docs`` with the 64-bit fingerprint as a (signed) long in place of the text."""

    def add(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [fingerprint(t.as_py(), shingle) for t in batch.column(text)]
        return [pa.array(np.array(made, np.uint64).view(np.int64))]

    return add_columns(docs.withColumn(text, F.col(f"`{text}`").cast("string")), f"`{out}` long", add, drop=(text,))


def gray_rank(code: Column) -> Column:
    """Place of a code in the binary reflected Gray sequence, as the bits of a long."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def masks(distance: int, within: int = (1 << BITS) - 1) -> list[int]:
    """distance + 1 disjoint masks that cover the bits of ``within``."""
    places = [b for b in range(BITS) if within >> b & 1]
    cuts = [round(i * len(places) / (distance + 1)) for i in range(distance + 2)]
    return [sum(1 << b for b in places[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


class Components:
    """Sets of linked places, merged pair by pair."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        parent = self.parent
        while True:
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared bits, their values) of the groups of each level, from single codes upwards."""
    ones, zeros = codes, ~codes
    levels = [(ones | zeros, ones)]
    while len(ones) > FANOUT:
        cuts = np.arange(0, len(ones), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
        levels.append((ones | zeros, ones))
    return levels


def link_node(codes: np.ndarray, distance: int, found: Components, base: int) -> None:
    """Link the codes (distinct, in Gray order) of one node that differ in few bits."""
    levels = _levels(codes)
    top = len(levels[-1][0])
    i, j = np.triu_indices(top)
    waiting = [(len(levels) - 1, i, j)]
    step = np.arange(FANOUT)
    while waiting:
        level, i, j = waiting.pop()
        if len(i) > CHUNK_PAIRS:
            waiting.append((level, i[CHUNK_PAIRS:], j[CHUNK_PAIRS:]))
            i, j = i[:CHUNK_PAIRS], j[:CHUNK_PAIRS]
        shared, value = levels[level]
        near = np.bitwise_count((value[i] ^ value[j]) & shared[i] & shared[j]) <= distance
        i, j = i[near], j[near]
        if level == 0:
            other = i != j
            found.link(base + i[other], base + j[other])
        elif len(i):
            size = len(levels[level - 1][0])
            a = (i[:, None, None] * FANOUT + step[None, :, None]).repeat(FANOUT, 2).ravel()
            b = (j[:, None, None] * FANOUT + step[None, None, :]).repeat(FANOUT, 1).ravel()
            inside = (a <= b) & (b < size)
            waiting.append((level - 1, a[inside], b[inside]))


def link_nodes(node: np.ndarray, codes: np.ndarray, distance: int) -> Components:
    """Link the codes of many nodes; ``node`` numbers them, and equal numbers stand together."""
    found = Components(len(codes))
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(node)])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        link_node(codes[start : start + size], distance, found, start)
    small = np.repeat(sizes <= SMALL, sizes)
    for gap in range(1, min(SMALL, len(codes))):
        same = np.flatnonzero(small[gap:] & (node[gap:] == node[:-gap]))
        if not len(same):
            break
        near = same[np.bitwise_count(codes[same] ^ codes[same + gap]) <= distance]
        found.link(near, near + gap)
    return found


def _masked(rows: DataFrame, children: dict[int, list[int]]) -> DataFrame:
    """(simhash, used, pattern): the members of the nodes below those whose shared bits are ``used``."""
    bits = lambda mask: F.lit(_signed(mask)).cast("long")
    below = F.create_map(*[x for u, m in children.items() for x in (bits(u), F.array(*map(bits, m)))])
    chosen = rows.select("simhash", F.explode(below[F.col("used")]).alias("used"))
    return chosen.withColumn("pattern", F.col("simhash").bitwiseAND(F.col("used")))


def node_members(codes: DataFrame, distance: int) -> DataFrame:
    """(simhash, used, pattern, first, second): the lowest nodes of masked patterns and their members.

    Codes that share the bits ``used`` differ in the other bits only. Where a node has more
    than ``NODE_LIMIT`` members, those bits are cut into ``distance`` + 1 masks once more, and
    its members go to the nodes below; two near codes agree on one of the masks at each of the
    ``LEVELS`` levels, so they meet in some lowest node. A lowest node that is still too large
    holds codes that agree nearly everywhere, which more masks would only copy. It is cut into
    blocks by a hash of the member, and each two blocks (first, second) meet.
    """
    every = (1 << BITS) - 1
    members = _masked(codes.select("simhash", F.lit(0).cast("long").alias("used")), {0: masks(distance)})
    one = F.lit(1).cast("long").alias("blocks")
    lowest = []
    for level in range(LEVELS):
        large = members.groupBy("used", "pattern").count().filter(F.col("count") > NODE_LIMIT)
        blocks = F.ceil(F.col("count") / NODE_LIMIT).alias("blocks")
        large = stored(large.select("used", "pattern", blocks), "large-nodes")
        cut = [r["used"] & every for r in large.select("used").distinct().collect()]  # masks, not data
        if not cut:
            lowest.append(members.select("*", one))
            break
        key = ["used", "pattern"]
        if level == LEVELS - 1:
            known = members.join(large, key, "left")
            lowest.append(known.select("simhash", *key, F.coalesce("blocks", one).alias("blocks")))
            break
        lowest.append(members.join(large, key, "left_anti").select("simhash", *key, one))
        upper = members.join(large, key, "left_semi")
        members = _masked(upper, {u: [u | m for m in masks(distance, every & ~u)] for u in cut})
    members = reduce(DataFrame.unionByName, lowest)
    own = F.pmod(F.xxhash64("simhash"), F.col("blocks"))
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, second = F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second")
    return members.select("simhash", "used", "pattern", first, second)


def links(codes: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that connect the fingerprints (column ``simhash``, distinct) within the distance.

    Of each node only a spanning forest is given, not all pairs. A task holds at most two
    blocks of ``NODE_LIMIT`` members.
    """
    key = ["used", "pattern", "first", "second"]
    members = node_members(codes, distance).select(*key, "simhash")
    sorted_nodes = members.repartition(*key).sortWithinPartitions(*key, gray_rank(F.col("simhash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: np.ndarray) -> pa.RecordBatch:
            node = np.cumsum(np.r_[0, (rows[1:, :4] != rows[:-1, :4]).any(1)])
            codes = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
            root = link_nodes(node, codes, distance).parent
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(rows[moved, 4]), pa.array(rows[root[moved], 4])], ["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in [*key, "simhash"]], axis=1)
            held.append(np.ascontiguousarray(rows))
            if sum(map(len, held)) >= 1 << 18:
                rows = np.concatenate(held)
                ends = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1))
                if len(ends):  # the last node may go on in the next batch
                    yield linked(rows[: ends[-1] + 1])
                    rows = rows[ends[-1] + 1 :]
                held = [rows]
        if held:
            yield linked(np.concatenate(held))

    return sorted_nodes.mapInArrow(run, "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near_duplicates(
    docs: DataFrame, shingle: int, distance: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, simhash, component_id) of each document.

    Documents are linked when their fingerprints differ in at most ``distance`` bits;
    component_id is the least key reachable over links. Texts that are null or have no word
    have fingerprint 0 and are linked like others. Rows with a null key are linked too, but
    give no name to their component, which is null if none of its rows has a key. Equal
    fingerprints are one member of the index, so the size of a group of copies does not
    matter. Repeated rows give a row each.
    """
    chosen = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text))
    prints = stored(add_fingerprints(chosen, shingle, text), "fingerprints")
    return _with_component(prints, distance, key).select(key, "simhash", "component_id")


def _with_component(prints: DataFrame, distance: int, key: str) -> DataFrame:
    """``prints`` (with a column simhash) with the root and the component_id of each row."""
    codes = stored(prints.groupBy("simhash").agg(F.min(key).alias("least")), "codes")
    roots = stored(component_roots(links(codes.select("simhash"), distance)), "roots")
    named = codes.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left")
    named = named.withColumn("root", F.coalesce("root", "simhash"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = named.join(names, "root").select("simhash", "root", "component_id")
    return prints.join(of_code, "simhash")


def one_of_each(docs: DataFrame, shingle: int, distance: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays.

    It is a row with the least key, or of those without a key if none has one; of several such
    rows the one with the least hash over all columns. Rows, not keys, are chosen: rows that
    share a key but not a component stay for each of their components.
    """
    first, second = (fresh(docs, c) for c in ("row", "other_row"))  # 128 bits of hash tell rows apart
    hashed = docs.withColumn(first, row_key(docs)).withColumn(second, F.xxhash64(F.lit(1), row_key(docs), F.col(f"`{key}`"), F.col(f"`{text}`")))
    chosen = hashed.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *[F.col(c) for c in (first, second)])
    prints = stored(add_fingerprints(chosen, shingle, "text"), "fingerprints")
    found = _with_component(prints, distance, "key")
    order = F.struct(F.col("key").isNull().alias("unnamed"), "key", first, second)
    leaders = stored(found.groupBy("root").agg(F.min(order).alias("leader")).select(f"leader.{first}", f"leader.{second}"), "leaders")
    kept = hashed.join(leaders, [first, second], "left_semi").dropDuplicates([first, second])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
