"""Removal of long byte strings that occur more than once, by suffix order.

Every string of ``length`` bytes holds an anchor: of the short grams inside it, the one with
the least hash (the leftmost of several). Equal strings have equal anchors, so they meet when
text is dealt out by anchor. Strings with one anchor at one place follow each other; they form
a run, and the bytes of a run are a segment. Runs whose anchor occurs once are unique and stay
where they are. Equal segments of an anchor are one with a weight. Different segments of an
anchor are sorted by suffix in shards, which shows what strings they share. Equal strings
also start equally far before their anchor, and what all strings in a range of such distances
have in common tells strings apart; by both, the segments of a frequent anchor are cut into
smaller groups, until each fits a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epimill.llm.bpe import unbundled
from epimill.llm.common import fresh, n_partitions, row_key, stored
from epimill.llm.suffixes import LCP_BITS, MOST_LCP, SEPARATOR, repeated_starts

LENGTH = 400
GRAM = 32
CHUNK = 1 << 18
PLACE_BITS = 20
SHARD_BYTES = 12 * 1024**2
GROUPS_PER_SHARD = 8
BUNDLE_BYTES = 1 << 25
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
MIXER = np.uint64(0x9E3779B97F4A7C15)


def runs_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor, place of the anchor) of each run of strings of ``length`` bytes.

    Works through a text in chunks. A run that a chunk cuts becomes two, which changes
    nothing for the strings in it, as their anchor is a matter of their own bytes.
    """
    gram = min(GRAM, length)
    width = length - gram + 1
    firsts, lasts, anchors, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    low = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, len(data) - length + 1, CHUNK):
        n = min(CHUNK, len(data) - length + 1 - at)
        with np.errstate(over="ignore"):
            code = data[at : at + n + length - 1].astype(np.uint64) + np.uint64(1)
            factor, size = MULTIPLIER, 1
            while size < gram:  # a polynomial over the gram, by doubling and a last overlap-free step
                step = min(size, gram - size)
                if step < size:
                    head = data[at : at + n + length - 1].astype(np.uint64)
                    for _ in range(step):
                        code = code[:-1] * MULTIPLIER + head[len(head) - len(code) + 1 :]
                else:
                    code = code[:-step] * factor + code[step:]
                    factor = factor * factor
                size += step
            code = (code ^ (code >> np.uint64(32))) * MIXER
            code ^= code >> np.uint64(29)
        key = code & ~low | np.arange(len(code), dtype=np.uint64)
        least, size = key, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[width - size : width - size + n])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        firsts.append(at + first)
        lasts.append(at + np.r_[first[1:], n] - 1)
        anchors.append(code[place[first]])
        places.append(at + place[first])
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(anchors), np.concatenate(places)


def _bytes(scalar: pa.Scalar) -> bytes:
    return scalar.as_buffer().to_pybytes() if scalar.is_valid else b""


def _place(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return first << 2 * LCP_BITS | (anchor - first) << LCP_BITS | (last - first)


def _unplaced(place: int) -> tuple[int, int, int]:
    """First start of a run, how far before its anchor that is, and how many starts follow."""
    return place >> 2 * LCP_BITS, place >> LCP_BITS & MOST_LCP, place & MOST_LCP


def anchors_of(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, n): anchors and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs_of(np.frombuffer(_bytes(t), np.uint8), length)[2] for t in batch.column("text")]
            anchor, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return texts.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def all_runs(texts: DataFrame, length: int) -> DataFrame:
    """(a, b, anchor, segment, place): the runs of each row; segment is a hash of the run's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            owner, places, anchors, segments = [], [], [], []
            for i, t in enumerate(batch.column("text")):
                data = _bytes(t)
                first, last, anchor, middle = runs_of(np.frombuffer(data, np.uint8), length)
                owner.append(np.full(len(first), i))
                places.append(_place(first, last, middle))
                anchors.append(anchor)
                segments += [digest(data[x : y + length]) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
            if not owner:
                continue
            rows = pa.array(np.concatenate(owner))
            columns = [
                batch.column("a").take(rows),
                batch.column("b").take(rows),
                pa.array(np.concatenate(anchors).view(np.int64)),
                pa.array(np.array(segments, np.uint64).view(np.int64)),
                pa.array(np.concatenate(places)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "anchor", "segment", "place"])

    return texts.mapInArrow(run, "a long, b int, anchor long, segment long, place long")


def compressed(texts: DataFrame, keep: list[str], once: bool = False) -> DataFrame:
    """Rows with their text compressed, for an exchange; ``once`` passes on one of a split's equal rows."""
    schema = T.StructType([*[texts.schema[c] for c in keep], T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True).compress
        seen: set[tuple[int, int]] = set()  # at most the rows of one split
        for batch in batches:
            if once:
                keys = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
                first = {key: i for i, key in reversed(list(enumerate(keys))) if key not in seen}
                seen.update(first)
                batch = batch.take(pa.array(sorted(first.values()), pa.int64()))
            packed = pa.array((pack(_bytes(t)) for t in batch.column("text")), pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], packed], schema.names)

    return texts.select(*keep, "text").mapInArrow(run, schema)


def _with_runs(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, packed, runs): the texts of the wanted segments, each with its own.

    A row that repeats in every column comes once from each split at most.
    """
    entry = F.struct("place", "anchor", "segment")
    of_row = wanted.groupBy("a", "b").agg(F.collect_list(entry).alias("runs"))
    return compressed(texts, ["a", "b"], once=True).join(of_row, ["a", "b"]).select("a", "b", "packed", "runs")


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(anchor, segment, distance of its first start to the anchor, bytes) of all runs.

    Equal rows stand side by side after a sorted join; one of them is enough.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    before = None
    for batch in batches:
        for a, b, packed, runs in zip(*(batch.column(c) for c in ("a", "b", "packed", "runs")), strict=True):
            row = a.as_py(), b.as_py()
            if row == before:
                continue
            before = row
            data = unpack(_bytes(packed))
            for r in runs.as_py():
                first, lead, more = _unplaced(r["place"])
                yield r["anchor"], r["segment"], lead, data[first : first + more + length]


def _bundles(rows: Iterator[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(shard, rows) from (shard, anchor, segment, at, bytes): what goes to one shard in one value."""
    names, kinds = ["anchor", "segment", "at", "bytes"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def bundle() -> pa.RecordBatch:
        shard, *columns = zip(*held, strict=True)
        shard = np.array(shard, np.int64)
        table = pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        found, rows = np.unique(shard), []
        for s in found:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.filter(pa.array(shard == s)))
            rows.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(rows, pa.binary())], ["shard", "rows"])

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BUNDLE_BYTES:
            yield bundle()
            held, size = [], 0
    if held:
        yield bundle()


def segments_in_shards(texts: DataFrame, wanted: DataFrame, n_shards: int, length: int) -> DataFrame:
    """(shard, rows): the bytes of the wanted segments, bundled for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _bundles((a % n_shards, a, s, 0, data) for a, s, _, data in _segments(batches, length))

    return _with_runs(texts, wanted).mapInArrow(run, "shard int, rows binary")


def pieces_in_shards(pieces: DataFrame, n_shards: int) -> DataFrame:
    """(shard, rows): the bytes of pieces of segments, bundled for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in PIECE_KEY), strict=True))
        return _bundles(((a ^ g) % n_shards, a, s, at, data) for a, g, s, at, data in rows)

    return pieces.select(*PIECE_KEY).mapInArrow(run, "shard int, rows binary")


PIECE_KEY = ["anchor", "group", "segment", "at", "bytes"]
PIECES = "anchor long, group long, piece long, segment long, at int, top int, bytes binary"


def _cut_pieces(rows: Iterator[tuple[int, int, int, int, bytes]], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of (anchor, segment, at, top, bytes) whose starts lie in one range of ``width`` distances.

    The first start of a piece is ``top`` bytes before the anchor and ``at`` bytes into its
    segment. ``group`` is a hash of the range and of the bytes that all strings of the range
    have in common, so strings of two groups differ; ``piece`` is a hash of the piece's bytes.
    """
    digest = xxhash.xxh3_64_intdigest
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        anchor, group, piece, segment, at, top, data = zip(*held, strict=True)
        signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (group, piece)]
        columns = [pa.array(anchor, pa.int64()), *signed, pa.array(segment, pa.int64())]
        columns += [pa.array(at, pa.int32()), pa.array(top, pa.int32()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "group", "piece", "segment", "at", "top", "bytes"])

    for anchor, segment, at, top, data in rows:
        bottom = top - (len(data) - length)
        for low in range(bottom - bottom % width, top + 1, width):
            first, last = min(top, low + width - 1), max(bottom, low)
            piece = data[top - first : top - last + length]
            group = digest(data[top - low : top - low - width + 1 + length], low << LCP_BITS | width)
            held.append((anchor, group, digest(piece), segment, at + top - first, first, piece))
            size += len(piece)
        if size >= BUNDLE_BYTES >> 2:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def split_crowded(texts: DataFrame, wanted: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(repeated, left) of the wanted segments, whose anchors have too many different ones for a shard.

    The starts of a segment are cut by their distance to the anchor, into ranges that are
    halved in each round. Pieces with one range and one common part form a group; only they
    may share strings. Equal pieces of a group are repeated as a whole, and one of them goes
    on. A group with one piece is done, one with at most ``most`` bytes is left to be sorted,
    and the others are cut again. In a range of one distance a piece is a string and its own
    common part, so no group has two and none is too large.

    repeated: (anchor, segment, starts), as ``shared_strings`` has them. left: pieces.
    """
    width = 1 << max(int(length - min(GRAM, length)).bit_length() - 1, 0)

    def first_cut(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
        return _cut_pieces(((a, s, 0, top, data) for a, s, top, data in _segments(batches, length)), width, length)

    pieces = stored(_with_runs(texts, wanted).mapInArrow(first_cut, PIECES), "pieces", compression="zstd")
    repeated, left = [], []
    group = ["anchor", "group"]
    size = F.octet_length("bytes")
    while True:
        same = pieces.groupBy(*group, "piece").agg(
            F.countDistinct("segment").alias("n"), F.min("segment").alias("segment"), F.max(size).alias("size")
        )
        same = stored(same, "equal-pieces", compression="zstd")
        several = same.filter(F.col("n") > 1).select(*group, "piece")
        starts = F.array(F.col("at"), F.col("at") + size - length).alias("starts")
        repeated.append(pieces.join(several, [*group, "piece"], "left_semi").select("anchor", "segment", starts))
        large = F.sum("size") > most
        mixed = same.groupBy(*group).agg(F.count("*").alias("n"), large.alias("large")).filter(F.col("n") > 1)
        alive = stored(same.join(mixed.select(*group, "large"), group).select(*group, "segment", "large"), "mixed-pieces")
        chosen = pieces.join(alive, [*group, "segment"])
        left.append(chosen.filter(~F.col("large")).select(*PIECE_KEY))
        if alive.filter("large").isEmpty():
            break
        width //= 2

        def next_cut(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            names = ["anchor", "segment", "at", "top", "bytes"]
            rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            return _cut_pieces(rows, width, length)

        cut = chosen.filter("large").select("anchor", "segment", "at", "top", "bytes").mapInArrow(next_cut, PIECES)
        pieces = stored(cut, "pieces", compression="zstd")
    return reduce(DataFrame.unionByName, repeated), reduce(DataFrame.unionByName, left)


def shared_strings(shards: DataFrame, length: int) -> DataFrame:
    """(anchor, segment, starts): for each segment, which of its strings another segment of its shard has.

    starts: first and last start, relative to the segment, of each run of such strings, in a row.
    """
    names = ["anchor", "segment", "starts"]

    def run(bundled: pa.Table) -> pa.Table:
        rows = pa.concat_tables([unbundled(r) for r in bundled.column("rows")])
        # a row that is given twice is one segment all the same
        keys = np.stack([np.asarray(rows.column(c)).astype(np.int64) for c in ("anchor", "segment", "at")], axis=1)
        first = np.sort(np.unique(keys, axis=0, return_index=True)[1])
        rows = rows.take(pa.array(first))
        parts = rows.column("bytes").to_pylist()
        text = np.frombuffer(bytes([SEPARATOR]).join(parts) + bytes([SEPARATOR]), np.uint8)
        repeated = repeated_starts(text, length)
        offsets = np.cumsum([0, *[len(p) + 1 for p in parts]])
        inside = np.zeros(len(text), np.int8)  # strings that do not reach over the end of a segment
        np.add.at(inside, offsets[:-1], 1)
        np.add.at(inside, offsets[1:] - length, -1)
        repeated &= np.cumsum(inside, dtype=np.int64) > 0
        edges = np.diff(np.r_[False, repeated, False].astype(np.int8))
        begins, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0) - 1
        owner = np.searchsorted(offsets, begins, "right") - 1
        found = [[] for _ in parts]
        shift = offsets[owner] - np.asarray(rows.column("at"))[owner]
        for o, x, y in zip(owner.tolist(), (begins - shift).tolist(), (ends - shift).tolist(), strict=True):
            found[o] += [x, y]
        some = [i for i, f in enumerate(found) if f]
        columns = [rows.column(c).take(pa.array(some, pa.int64())) for c in ("anchor", "segment")]
        return pa.table([*columns, pa.array([found[i] for i in some], pa.list_(pa.int32()))], names=names)

    return shards.groupBy("shard").applyInArrow(run, "anchor long, segment long, starts array<int>")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, spans, kept): each text without strings that occur elsewhere.

    A byte is removed if a string of ``length`` bytes over it also starts at another place, in
    any text or the same one, overlaps included; no string reaches over the end of a text.
    ``spans`` has the start and end of each maximal removed run of bytes, ``kept`` the bytes
    that are left. Null and empty texts have no bytes; repeated rows repeat each other.

    Rows are told apart by 96 bits of hash over all their columns. Texts are read three times
    and cross an exchange, compressed, twice: to cut out the segments that have to be sorted,
    and to cut out what was found. Of equal segments one is sorted, so a group of copies or a
    passage in many documents counts as one. Shards have about ``SHARD_BYTES`` bytes. What is
    dealt to one as a whole, the segments of an anchor, is at most a part of that: an anchor
    with more has its segments cut by ``split_crowded``.
    """
    if length > MOST_LCP:
        raise ValueError(f"common prefixes are carried up to {MOST_LCP} symbols")
    docs = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias(fresh(docs, "body")))
    body = docs.columns[1]
    hashed = row_key(docs)
    texts = docs.select(
        hashed.alias("a"),
        F.xxhash64(F.lit(1), *docs.columns).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("b"),
        F.col(key).alias("key"),
        F.encode(F.coalesce(F.col(body), F.lit("")), "utf-8").alias("text"),
    )
    bodies = texts.select("a", "b", "text")
    repeated = stored(anchors_of(texts, length).filter(F.col("n") > 1).select("anchor"), "anchors")
    runs = stored(all_runs(bodies, length).join(repeated, "anchor"), "runs", compression="zstd")
    rep = F.min(F.struct("a", "b", "place")).alias("rep")
    segments = runs.groupBy("anchor", "segment").agg(F.count("*").alias("weight"), rep)
    segments = stored(segments.select("anchor", "segment", "weight", "rep.*"), "segments", compression="zstd")
    size = F.sum(F.col("place").bitwiseAND(F.lit(MOST_LCP)) + length)
    most = SHARD_BYTES // GROUPS_PER_SHARD
    mixed = segments.groupBy("anchor").agg(F.count("*").alias("n"), (size > most).alias("crowded")).filter(F.col("n") > 1)
    wanted = segments.join(mixed.select("anchor", "crowded"), "anchor")
    wanted = stored(wanted.select("a", "b", "place", "anchor", "segment", "crowded"), "wanted")
    total = {r["crowded"]: r["size"] for r in wanted.groupBy("crowded").agg(size.alias("size")).collect()}
    to_sort, repeats = total.get(False, 0), []
    if True in total:
        repeated, left = split_crowded(bodies, wanted.filter("crowded"), length, most)
        left = stored(left, "left-pieces", compression="zstd")
        to_sort += left.select(F.sum(F.octet_length("bytes"))).first()[0] or 0
        repeats = [repeated]
    n_shards = n_partitions(docs.sparkSession, to_sort, SHARD_BYTES)
    shards = segments_in_shards(bodies, wanted.filter(~F.col("crowded")), n_shards, length)
    if repeats:
        shards = shards.unionByName(pieces_in_shards(left, n_shards))
    shared = reduce(DataFrame.unionByName, [stored(shared_strings(shards, length), "shared"), *repeats])

    # all strings of a segment that occurs twice, and those that another segment has
    whole = segments.filter(F.col("weight") > 1).select("anchor", "segment", F.lit(None).cast("array<int>").alias("starts"))
    heavy = segments.filter(F.col("weight") > 1).select("anchor", "segment")
    part = shared.join(heavy, ["anchor", "segment"], "left_anti")
    found = stored(part.unionByName(whole), "found")
    hits = runs.join(found, ["anchor", "segment"]).select("a", "b", F.struct("place", "starts").alias("hit"))
    of_row = hits.groupBy("a", "b").agg(F.collect_set("hit").alias("hits"))
    packed = compressed(texts, ["a", "b", "key"])
    return _cut(packed.join(of_row, ["a", "b"], "left"), key, length)


def _cut(rows: DataFrame, key: str, length: int) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()
    names = [key, "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            made = []
            for packed, hits in zip(batch.column("packed"), batch.column("hits"), strict=True):
                data = _bytes(packed)
                data = unpack(data) if data else b""
                firsts, lasts = [], []
                for hit in hits.as_py() or ():
                    at, _, more = _unplaced(hit["place"])
                    starts = hit["starts"] or [0, more]
                    firsts += [at + x for x in starts[::2]]
                    lasts += [at + y for y in starts[1::2]]
                cover = np.zeros(len(data) + 1, np.int64)
                np.add.at(cover, np.array(firsts, np.int64), 1)
                np.add.at(cover, np.array(lasts, np.int64) + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edges = np.diff(np.r_[False, gone, False].astype(np.int8))
                spans = list(zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
                dicts = [{"start": x, "end": y} for x, y in spans]
                made.append((len(data), len(data) - len(kept), len(spans), dicts, kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True) if made else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names)

    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
    return rows.select("key", "packed", "hits").mapInArrow(run, schema)
