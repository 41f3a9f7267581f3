"""Bounded-space online best-fit packing of tokenised documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epimill.llm.bpe import word_memo
from epimill.llm.common import fresh, stored

SEQUENCE_TOKENS = 2048
OPEN_BINS = 1024
PIECES_PER_TASK = 250_000


def pieces_of(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    size: int = SEQUENCE_TOKENS,
    end_id: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: (key, piece, start, length, ids_crc32, ids).

    A document's ids are its tokens and the end id. Only documents longer than ``size`` are
    cut. ``ids`` holds the piece as little-endian 32-bit integers, and is null unless
    ``with_ids``. A null text is empty.
    """
    end = end_id.to_bytes(4, "little")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    names = [key, "piece", "start", "length", "ids_crc32", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(path)
        for batch in batches:
            rows: list[tuple] = []
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                ids, k = memo.encode(t.as_py()) + end, k.as_py()
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((k, n, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(cut, schema)


class OpenBins:
    """A fixed number of open bins; a bitset has a bit for each free space that some bin has."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.count = size, limit, 0
        self.bits = 0
        self.by_space: list[list[list]] = [[] for _ in range(size + 1)]

    def _take(self, space: int) -> list:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.count -= 1
        return found

    def _put(self, space: int, content: list) -> None:
        self.by_space[space].append(content)
        self.bits |= 1 << space
        self.count += 1

    def add(self, item: int, length: int) -> list[list]:
        """Place an item in the fullest bin that has room; the bins that close by it."""
        closed = []
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            content = self._take(space)
        else:
            if self.count >= self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            space, content = self.size, []
        content.append(item)
        if space == length:
            closed.append(content)
        else:
            self._put(space - length, content)
        return closed

    def rest(self) -> list[list]:
        found = [content for bins in self.by_space for content in bins]
        self.__init__(self.size, self.limit)
        return found


def pack(
    pieces: DataFrame,
    size: int = SEQUENCE_TOKENS,
    open_bins: int = OPEN_BINS,
    per_task: int = PIECES_PER_TASK,
    length: str = "length",
) -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece lies, gapless from 0.

    Pieces are stored, dealt out by a hash of their columns and place, and arrive in the order of
    another hash, so that a task that runs again packs the same sequences, and pieces that
    repeat in every column go to all tasks. Each task packs online with
    ``open_bins`` bins: a piece goes to the fullest bin with room for it; where there is none
    and all bins are open, the fullest closes. A task holds its open bins and the pieces of
    one batch. Only a task's last bins can stay part empty, so tasks get many pieces each.

    Every length must be from 1 to ``size``. Null keys, ties and repeated rows are pieces
    like any other. Columns called sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    pieces = stored(pieces.select(*[F.col(f"`{c}`") for c in kept]), "pieces")
    n_tasks = max(1, -(-pieces.count() // per_task))
    columns = [F.col(f"`{c}`") for c in kept]
    place, order, task_id = (fresh(pieces, name) for name in ("place", "order", "task"))
    dealt = (
        pieces.withColumn(place, F.monotonically_increasing_id())  # the same when a task runs again, as the table is stored
        .repartition(n_tasks, *columns, place)
        .withColumn(order, F.xxhash64(F.lit(size), *columns, place))
        .sortWithinPartitions(order, place)
        .withColumn(task_id, F.spark_partition_id())
    )
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    at_length = kept.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, held, made, task, next_item = OpenBins(size, open_bins), {}, 0, 0, 0

        def rows(closed: list[list]) -> pa.RecordBatch:
            nonlocal made
            out: list[tuple] = []
            for content in closed:
                at = 0
                for item in content:
                    row = held.pop(item)
                    out.append((*row, (task << 40) + made, at))
                    at += row[at_length]
                made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow_schema, strict=True)], names
            )

        names, arrow_schema = schema.names, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if arrow_schema is None:
                fields = [batch.schema.field(c) for c in kept]
                arrow_schema = [*fields, pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())]
                task = batch.column(task_id)[0].as_py()
            closed = []
            for row in zip(*[batch.column(c).to_pylist() for c in kept], strict=True):
                if not 1 <= (row[at_length] or 0) <= size:
                    raise ValueError(f"a piece of {row[at_length]} tokens does not fit a sequence of {size}")
                held[next_item] = row
                closed += bins.add(next_item, row[at_length])
                next_item += 1
            if closed:
                yield rows(closed)
        if closed := bins.rest():
            yield rows(closed)

    return dealt.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE_TOKENS, end_id: int = 0
) -> DataFrame:
    """Where each piece of each document lies: (key, piece, start, length, ids_crc32, sequence_id, offset).

    The documents are tokenised once, where they are read; the table of pieces, a few
    numbers each, is stored in the shared folder, so a lost task repeats the packing alone.
    """
    pieces = pieces_of(docs, path, key, text, size, end_id, with_ids=False).drop("ids")
    return pack(pieces, size)
