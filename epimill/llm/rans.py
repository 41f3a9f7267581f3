"""Token files: ids of documents in ascending order, range-coded in independent blocks.

A folder holds three Parquet tables, which Spark writes and reads:

- ``frequencies`` (id, frequency): the one static model of all blocks; the frequencies of
  the ids that occur add up to a power of two.
- ``blocks``: one row per block of whole documents: part and block number, ids of the part
  before it, document keys and lengths, the 32-bit words of ``LANES`` interleaved coders,
  checkpoints (coder states and place in the words) and the CRC-32 of its ids.
- ``parts`` (part, before): ids of all parts before a part.

A coder is a range asymmetric numeral system with a 64-bit state and 32-bit output words.
Checkpoints split a block into runs of rows that decode side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epimill.llm.bpe import id_type, word_memo
from epimill.llm.common import fresh, n_partitions, stored

LANES = 1024
CHECKPOINT_ROWS = 256
BLOCK_TOKENS = 1 << 20
PART_BYTES = 256 * 1024**2
LOW = np.uint64(31)
WORD = np.uint64(32)


class Model:
    """Static frequencies scaled to a power of two, with at least 1 for each id that occurs."""

    def __init__(self, ids: np.ndarray, frequencies: np.ndarray):
        self.ids = np.asarray(ids, np.uint32)
        self.frequency = np.asarray(frequencies, np.uint64)
        total = int(self.frequency.sum()) if len(ids) else 1
        self.bits = np.uint64(total.bit_length() - 1)
        if total != 1 << int(self.bits):
            raise ValueError("frequencies must add up to a power of two")
        self.before = np.cumsum(self.frequency) - self.frequency
        self.symbol_at = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.frequency.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray, bits: int = 20) -> np.ndarray:
        """Counts scaled to a sum of a power of two; what is left over goes to the largest."""
        counts = np.asarray(counts, np.int64)
        if not len(counts):
            return counts
        bits = max(bits, len(counts).bit_length() + 4)
        total = 1 << bits
        spare = total - len(counts)
        made = 1 + (counts.astype(np.float64) * (spare / counts.sum())).astype(np.int64)
        made[np.argmax(made)] += total - made.sum()
        return made

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        place = np.zeros(int(self.ids.max()) + 1, np.int32)
        place[self.ids] = np.arange(len(self.ids), dtype=np.int32)
        return place[ids]

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, states at the checkpoints, words before each checkpoint)."""
        symbols = self.symbols(ids)
        n_rows = -(-len(symbols) // LANES)
        state = np.full(LANES, 1 << 31, np.uint64)
        limit_shift = np.uint64(63) - self.bits
        words: list[np.ndarray] = []
        states: list[np.ndarray] = []
        for row in range(n_rows - 1, -1, -1):
            s = symbols[row * LANES : (row + 1) * LANES]
            f, x = self.frequency[s], state[: len(s)]
            full = x >= f << limit_shift
            words.append(x[full].astype(np.uint32))
            x = np.where(full, x >> WORD, x)
            q = x // f
            state[: len(s)] = (q << self.bits) + (x - q * f) + self.before[s]
            if row % CHECKPOINT_ROWS == 0:
                states.append(state.copy())
        words.reverse()
        states.reverse()
        sizes = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        joined = np.concatenate(words) if words else np.zeros(0, np.uint32)
        return joined, np.array(states, np.uint64).reshape(-1, LANES), sizes[:-1:CHECKPOINT_ROWS]

    def _decode_runs(self, words: np.ndarray, states: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """``n`` symbols of each of several runs, decoded side by side."""
        x, at = states.copy(), at.copy()
        out = np.empty((len(states), n), np.int32)
        mask = np.uint64((1 << int(self.bits)) - 1)
        for start in range(0, n, LANES):
            width = min(LANES, n - start)
            part = x[:, :width]
            slot = part & mask
            s = self.symbol_at[slot.astype(np.int64)]
            out[:, start : start + width] = s
            part = self.frequency[s] * (part >> self.bits) + slot - self.before[s]
            short = part < np.uint64(1 << 31)
            taken = np.cumsum(short, axis=1)
            place = (at[:, None] + taken - 1)[short]
            part[short] = (part[short] << WORD) | words[place].astype(np.uint64)
            at += taken[:, -1]
            x[:, :width] = part
        return out

    def decode(self, words: np.ndarray, states: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        run = LANES * CHECKPOINT_ROWS
        whole = n // run
        symbols = [np.zeros(0, np.int32)]
        if whole:
            symbols.append(self._decode_runs(words, states[:whole], at[:whole], run).ravel())
        if n % run:
            symbols.append(self._decode_runs(words, states[whole:], at[whole:], n % run).ravel())
        return self.ids[np.concatenate(symbols)]


def narrow_ids(path: str, end_id: int) -> bool:
    """Whether 16 bits hold every id."""
    return id_type(path) == "<u2" and end_id < 1 << 16


def tokenised(docs: DataFrame, path: str, key: str, text: str, end_id: int) -> DataFrame:
    """(key, ids as bytes) with ``end_id`` after each document; 16-bit ids where they suffice."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(path)
        narrow = narrow_ids(path, end_id)
        for batch in batches:
            ids = (memo.encode(t.as_py()) + end for t in batch.column(1))
            if narrow:
                ids = (np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids)
            column = pa.array(ids, pa.binary())
            wide = pa.array([not narrow] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), column, wide], [key, "ids", "wide"])

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias(text))
    return chosen.mapInArrow(run, f"`{key}` {kind}, ids binary, wide boolean")


def _array(ids: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if wide else "<u2")


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for wide in (False, True):
                own = batch.filter(pa.array(np.asarray(batch.column("wide")) == wide))
                if own.num_rows:
                    counts = np.bincount(_array(b"".join(own.column("ids").to_pylist()), wide))
                    size = max(len(counts), len(total))
                    total = np.pad(total, (0, size - len(total))) + np.pad(counts, (0, size - len(counts)))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    counted = tokens.select("ids", "wide").mapInArrow(run, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> None:
    """Write the documents' ids, in ascending order of ``key``, to token files in ``folder``.

    The tokenised texts are stored once in the shared folder; counts and files are both made
    from them. They are range-partitioned by key (then a hash of the ids and the row's place, so that
    neither one key nor rows that repeat in every column can fill a part) and coded part by part.
    A task holds one block. Null texts are empty documents of the end id alone; null keys come
    first; rows with equal keys lie in the order of a hash of their ids. An empty table gives empty files.
    """
    spark = docs.sparkSession
    tokens = stored(tokenised(docs, path, key, text, end_id), "token-ids", compression="zstd")
    counts = frequencies(tokens).orderBy("id").toPandas()  # a row per id of the vocabulary at most
    scaled = Model.scaled(counts["n"].to_numpy())
    known = spark.createDataFrame(
        pa.table({"id": pa.array(counts["id"].to_numpy(), pa.int64()), "frequency": pa.array(scaled, pa.int64())})
    )
    known.coalesce(1).write.parquet(f"{folder}/frequencies")
    ids = counts["id"].to_numpy()
    width = 2 if narrow_ids(path, end_id) else 4
    n_parts = n_partitions(spark, width * int(counts["n"].sum()), PART_BYTES)
    # the tokens are stored, so a row's place is the same when a task runs again
    place = fresh(tokens, "place")
    hashed = tokens.withColumn("tie", F.xxhash64("ids")).withColumn(place, F.monotonically_increasing_id())
    by_key = F.col(f"`{key}`").asc_nulls_first()
    ordered = hashed.repartitionByRange(n_parts, by_key, "tie", place).sortWithinPartitions(by_key, "tie", "ids")
    kind = tokens.schema[key].dataType.simpleString()
    schema = (
        f"part int, block int, before long, n long, keys array<{kind}>, lengths array<int>, words binary, "
        "states binary, places array<long>, crc32 long"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, block, before = Model(ids, scaled), 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        size, part, key_type = 0, 0, None

        def closed() -> pa.RecordBatch:
            nonlocal block, before, size, keys, held
            values = np.concatenate(held).astype("<u4")
            words, states, places = model.encode(values)
            row = [
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([size]),
                pa.array([keys], pa.list_(key_type)), pa.array([[len(h) for h in held]], pa.list_(pa.int32())),
                pa.array([words.tobytes()], pa.binary()), pa.array([states.tobytes()], pa.binary()),
                pa.array([places.tolist()], pa.list_(pa.int64())), pa.array([zlib.crc32(values.tobytes())]),
            ]
            block, before, size, keys, held = block + 1, before + size, 0, [], []
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key_type, part = batch.schema.field(key).type, batch.column("part")[0].as_py()
            columns = (batch.column(c) for c in (key, "ids", "wide"))
            for k, x, wide in zip(*columns, strict=True):
                keys.append(k.as_py())
                held.append(_array(x.as_py(), wide.as_py()))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield closed()
        if held:
            yield closed()

    blocks = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(code, schema)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    sizes = spark.read.schema(blocks.schema).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    # one row per part, whatever the number of documents
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes.select("part", before.cast("long").alias("before_part")).coalesce(1).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of each document; ids as little-endian 32-bit integers.

    ``start`` counts the ids of all documents before it. Blocks decode independently; a block
    whose ids do not have the stored checksum stops the job.
    """
    model_rows = spark.read.parquet(f"{folder}/frequencies").orderBy("id").toPandas()
    ids, scaled = model_rows["id"].to_numpy(), model_rows["frequency"].to_numpy()
    blocks = spark.read.parquet(f"{folder}/blocks").join(spark.read.parquet(f"{folder}/parts"), "part", "left")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    names = [key, "start", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(ids, scaled)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                states = np.frombuffer(row["states"].as_py(), np.uint64).reshape(-1, LANES)
                values = model.decode(
                    np.frombuffer(row["words"].as_py(), np.uint32),
                    states,
                    np.array(row["places"].as_py(), np.int64),
                    row["n"].as_py(),
                ).astype("<u4")
                data = values.tobytes()
                if zlib.crc32(data) != row["crc32"].as_py():
                    raise ValueError(f"block {row['block']} of part {row['part']} does not have its checksum")
                lengths = np.array(row["lengths"].as_py(), np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                start = row["before"].as_py() + row["before_part"].as_py() + offsets[:-1]
                parts = pa.Array.from_buffers(
                    pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets * 4), pa.py_buffer(data)]
                )
                yield pa.RecordBatch.from_arrays(
                    [row["keys"].values, pa.array(start), pa.array(lengths), parts.cast(pa.binary())], names
                )

    one_by_one = blocks.select(
        "part", "block", "before", "before_part", "n", "keys", "lengths", "words", "states", "places", "crc32"
    )
    return one_by_one.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids binary")
