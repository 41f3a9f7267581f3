"""Scores of documents by a word model that is learned from all training documents.

Texts are split once: a block of documents numbers its own words, and a table of (block, word)
with counts is summed to the corpus's counts, joined back and dealt to the blocks again. The
recurrent network is trained in rounds. A round's documents are dealt to cells; each cell
trains a copy of the weights by truncated backpropagation, and the copies are averaged, by the
words they have seen, for the next round. Every training document is in one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epimill.llm import gru
from epimill.llm.common import fresh, grouped, n_partitions, stored

WORDS = 1600
HIDDEN = 16
ROUNDS = 4
RATE = 0.01
BLOCK_TOKENS = 1 << 21
CELL_TOKENS = 1 << 22
SCORED_TOKENS = 1 << 22
PIECES = 16
SALTS = 32
SLICE = 2_000
WORDS_SLICE = 50_000


def _batch(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def numbered_words(docs: DataFrame) -> DataFrame:
    """Documents as numbers of their block's words, and the words of each block, an Arrow batch.

    docs: (key, training, text). Rows with a word have (block, local, word, n), n in training
    documents; the others have (block, key, training, ids), ids packed 32-bit local numbers.
    """
    kind = docs.schema["key"].dataType
    fields = [("block", T.LongType()), ("word", T.StringType()), ("local", T.IntegerType()), ("n", T.LongType())]
    fields += [("key", kind), ("training", T.BooleanType()), ("ids", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for number, batch in enumerate(batches):
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), batch.schema.field("key").type, pa.bool_(), pa.binary()]
            made = pa.schema(list(zip([f[0] for f in fields], kinds, strict=True)))
            lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))
            found = lists.flatten()
            some = pc.greater(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)  # white space at an end gives an empty one
            ends = np.r_[0, np.cumsum(some)][np.asarray(lists.offsets) - lists.offsets[0].as_py()]
            coded = found.filter(pa.array(some)).dictionary_encode()
            ids = np.asarray(coded.indices).astype(np.uint32)
            learned = np.repeat(np.asarray(batch.column("training")), np.diff(ends))
            counts = np.bincount(ids[learned], minlength=len(coded.dictionary))
            block = task << 32 | number
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                cuts = ends[at : at + part.num_rows + 1].tolist()
                packed = pa.array([pack(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
                columns = {"block": pa.array(np.full(part.num_rows, block)), "ids": packed}
                yield _batch(columns | {c: part.column(c) for c in ("key", "training")}, made)
            for at in range(0, len(counts), WORDS_SLICE):
                words = coded.dictionary.slice(at, WORDS_SLICE)
                local = np.arange(at, at + len(words))
                columns = {"block": pa.array(np.full(len(words), block)), "word": words}
                yield _batch(columns | {"local": pa.array(local.astype(np.int32)), "n": pa.array(counts[local])}, made)

    return docs.mapInArrow(run, schema)


def frequent_words(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The ``most`` words of highest count, at least 1; ties go to the smaller word."""
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    levels = counts.filter("n > 0").groupBy(level).count().orderBy(F.desc("level")).collect()  # 512 at most
    held, least = 0, 0
    for row in levels:
        held, least = held + row["count"], row["level"]
        if held >= most:
            break
    chosen = counts.filter("n > 0").filter(F.floor(F.log2("n") * 8) >= least)
    return [(r["word"], r["n"]) for r in chosen.orderBy(F.desc("n"), "word").limit(most).collect()]


def average(weights: DataFrame) -> np.ndarray:
    """The mean of copies of the weights, given in pieces as (piece, salt, size, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["piece", "salt", "size", "total"]
        for batch in summed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(batch, kinds, strict=True)], names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, size, total = None, 0, None
        for batch in batches:
            for piece, salt, own, values in zip(*(batch.column(c) for c in ("piece", "salt", "size", "total")), strict=True):
                values = np.frombuffer(values.as_buffer(), np.float64)
                if (piece.as_py(), salt.as_py()) != at:
                    if at:
                        yield *at, size, total.tobytes()
                    at, size, total = (piece.as_py(), salt.as_py()), 0, np.zeros(len(values))
                size, total = size + own.as_py(), total + values
        if at:
            yield *at, size, total.tobytes()

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    schema = "piece int, salt int, size long, total binary"
    for _ in range(2):  # by salt, then all of a piece
        weights = weights.repartition("piece", "salt").sortWithinPartitions("piece", "salt").mapInArrow(run, schema)
        weights = weights.withColumn("salt", F.lit(0)).select("piece", "salt", "size", "total")
    found = sorted(weights.collect(), key=lambda r: r["piece"])  # one row for each piece
    return np.concatenate([np.frombuffer(r["total"], np.float64) / r["size"] for r in found]).astype(np.float32)


def train(encoded: DataFrame, shape: gru.Shape, flat: np.ndarray, tokens: int, rounds: int, rate: float) -> np.ndarray:
    """Weights after ``rounds`` rounds over the (ids) of training documents, each in one of them."""
    n_cells = max(1, round(tokens / rounds / CELL_TOKENS))
    mixed = F.xxhash64("ids", "key")
    rows = encoded.filter("training").select(
        F.pmod(mixed, F.lit(rounds)).cast("int").alias("round"),
        F.pmod(F.xxhash64(mixed), F.lit(n_cells)).cast("int").alias("cell"),
        mixed.alias("mixed"),
        "ids",
    )
    kind = _id_type(shape)

    def cell_trained(flat: np.ndarray, rate: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor().decompress
            for (cell,), docs in grouped(batches, "cell"):
                stream = np.concatenate([np.frombuffer(unpack(x.as_buffer()), kind) for x in docs.column("ids")])
                after = gru.train(shape, flat, stream, rate).astype(np.float64) * len(stream)
                pieces = [p.tobytes() for p in np.array_split(after, PIECES)]
                columns = [
                    pa.array(range(PIECES), pa.int32()), pa.array([cell % SALTS] * PIECES, pa.int32()),
                    pa.array([len(stream)] * PIECES, pa.int64()), pa.array(pieces, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["piece", "salt", "size", "total"])

        return run

    for number in range(rounds):
        own = rows.filter(F.col("round") == number).drop("round")
        dealt = own.repartition(n_cells, "cell").sortWithinPartitions("cell", "mixed").drop("mixed")
        made = dealt.mapInArrow(cell_trained(flat, rate / (1 + number)), "piece int, salt int, size long, total binary")
        made = stored(made, "weights")
        if not made.isEmpty():
            flat = average(made)
    return flat


def _id_type(shape: gru.Shape) -> str:
    return "<u2" if shape.words <= 1 << 16 else "<u4"


def score(
    docs: DataFrame,
    is_training: Column,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    hidden: int = HIDDEN,
    rounds: int = ROUNDS,
    rate: float = RATE,
) -> DataFrame:
    """(key, training, n_tokens, n_known, train_tokens, base_score, score) of each document.

    Tokens are the words of the text, ``A`` to ``Z`` lower-cased and cut at ASCII white space,
    and one end. With c a token's count, N all counts and V the distinct tokens, in the training
    documents, ``n_known`` counts the tokens with c > 0 and ``base_score`` sums
    log10((c + 1) / (N + V + 1)). ``score`` is the log10 chance of the text by a recurrent network
    over the ``words`` most frequent words, the end and one rare word; a rare word has the share
    (c + 1) / (N' + V' + 1) of the rare word's chance, over the words that are not frequent.

    Null and empty texts are an end alone. Rows are kept one by one, repeated rows included; a null
    ``is_training`` counts as false. Without training documents all words are rare and unseen.
    Other columns are not read. An empty table gives none. A task holds the words of one block,
    the documents of one cell, or a bounded number of words to score; a long text is one document.
    The weights have a fixed size; all counts and all training documents enter. Texts split in tasks
    are a batch of Arrow at once, which a session setting bounds in bytes.
    """
    spark = docs.sparkSession
    flag = fresh(docs, "training")
    chosen = docs.withColumn(flag, F.coalesce(is_training, F.lit(False))).select(
        F.col(f"`{key}`").alias("key"),
        F.col(flag).alias("training"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    numbered = stored(numbered_words(chosen), "numbered", compression="zstd")
    word_rows = numbered.filter(F.col("word").isNotNull()).select("block", "local", "word", "n")
    doc_rows = numbered.filter(F.col("word").isNull()).select("block", "key", "training", "ids")
    counts = stored(word_rows.groupBy("word").agg(F.sum("n").alias("n")), "word-counts", compression="zstd")
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends = doc_rows.filter("training").count()
    total, distinct = seen["n"] + ends, seen["v"] + (ends > 0)
    frequent = frequent_words(counts, words)
    rare_total, rare_distinct = seen["n"] - sum(n for _, n in frequent), seen["v"] - len(frequent)

    vocabulary = spark.createDataFrame(  # a parameter bounds it
        pa.table({"word": pa.array([w for w, _ in frequent], pa.string()), "id": pa.array(range(2, len(frequent) + 2), pa.int32())})
    )
    known = word_rows.drop("n").join(counts.join(vocabulary, "word", "left"), "word")
    known = known.select("block", "local", "n", F.coalesce("id", F.lit(gru.RARE)).alias("id"))
    shape = gru.Shape(len(frequent) + 2, hidden)
    kind = _id_type(shape)
    both = doc_rows.withColumn("local", F.lit(None).cast("int")).unionByName(known, allowMissingColumns=True)
    dealt = both.repartition(n_partitions(spark, total, BLOCK_TOKENS), "block")
    dealt = dealt.sortWithinPartitions("block", F.col("local").isNull())
    schema = T.StructType([doc_rows.schema["key"], doc_rows.schema["training"]])
    for name, of in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("rare", "double"), ("ids", "binary")):
        schema = schema.add(name, of)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1, write_checksum=False)
        block, parts = None, []
        end_share = np.log10((ends + 1) / (total + distinct + 1))
        in_base = shares = ids_of = is_known = None
        for batch in batches:
            is_doc = np.asarray(batch.column("local").is_null())
            owner = np.asarray(batch.column("block"))
            at = 0
            while at < len(owner):  # runs of one block and kind
                same = (owner[at:] == owner[at]) & (is_doc[at:] == is_doc[at])
                end = at + (len(same) if same.all() else int(np.argmin(same)))
                part = batch.slice(at, end - at)
                if owner[at] != block:
                    block, parts, in_base = owner[at], [], None
                if not is_doc[at]:
                    parts.append([np.asarray(part.column(c)) for c in ("local", "n", "id")])
                else:
                    if in_base is None:  # words come before documents
                        local = np.concatenate([np.zeros(0, np.int32), *[p[0] for p in parts]])
                        n, ids_of = np.zeros(len(local)), np.zeros(len(local), kind)
                        n[local] = np.concatenate([np.zeros(0), *[p[1] for p in parts]])
                        ids_of[local] = np.concatenate([np.zeros(0), *[p[2] for p in parts]])
                        is_known, parts = n > 0, []
                        in_base = np.log10((n + 1) / (total + distinct + 1))
                        shares = np.where(ids_of == gru.RARE, np.log10((n + 1) / (rare_total + rare_distinct + 1)), 0.0)
                    for i in range(0, part.num_rows, SLICE):
                        some, made = part.slice(i, SLICE), []
                        for packed in some.column("ids"):
                            local = np.frombuffer(codec[0].decompress(packed.as_buffer()), np.uint32)
                            ids = np.append(ids_of[local], np.array([gru.END], kind))
                            n_known = int(is_known[local].sum()) + (ends > 0)
                            base, rare = float(in_base[local].sum() + end_share), float(shares[local].sum())
                            made.append((len(ids), n_known, base, rare, codec[1].compress(ids.tobytes())))
                        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
                        columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays([some.column("key"), some.column("training"), *columns], schema.names)
                at = end

    encoded = stored(dealt.mapInArrow(encode, schema), "encoded", compression="zstd")
    first = gru.first_weights(shape, np.array([ends, rare_total, *[n for _, n in frequent]], float))
    flat = train(encoded, shape, first, total, rounds, rate)

    names = [key, "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    made_of = doc_rows.schema["key"].dataType.simpleString()
    out = f"`{key}` {made_of}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def rate_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, ids, size = [], [], 0

        def rated() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            scores = gru.score(shape, flat, ids) + np.asarray(rows.column("rare"))
            own = [rows.column(c).combine_chunks() for c in ("key", "training", "n_tokens", "n_known")]
            columns = [*own, pa.array(np.full(len(ids), total, np.int64)), rows.column("base_score").combine_chunks(), pa.array(scores)]
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

        for batch in batches:
            at = 0
            for i, packed in enumerate(batch.column("ids")):
                ids.append(np.frombuffer(unpack(packed.as_buffer()), kind))
                size += len(ids[-1])
                if size >= SCORED_TOKENS or i + 1 == batch.num_rows:
                    held.append(batch.slice(at, i + 1 - at).drop_columns(["ids"]))
                    at = i + 1
                if size >= SCORED_TOKENS:
                    yield rated()
                    held, ids, size = [], [], 0
        if ids:
            yield rated()

    return encoded.mapInArrow(rate_documents, out)
