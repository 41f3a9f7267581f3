"""BPE encoding through a table of distinct words, decoding through an id-to-piece lookup."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from epimill.llm.common import SLICE_ROWS, add_columns, fresh, list_of, row_key, without

# The splitting that the fast path repeats for Latin-1 texts. Files with
# another normalizer or splitter are split by the library alone.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"


def _lower_words(letter: str, digit: str, space: str) -> re.Pattern:
    """``SPLIT`` for lower-case texts of few characters, the usual alternative first."""
    return re.compile(f"[{letter}]+|[{digit}]|'(?:[stmd]|re|ve|ll)|[^{space}{letter}{digit}]+")


ASCII_WORDS = _lower_words("a-z", "0-9", "\t-\r ")
LATIN_WORDS = _lower_words(LETTER, DIGIT, SPACE)
BEYOND_LATIN = re.compile("[^\x00-\xff]")

MEMO_WORDS = 400_000
BLOCK_BYTES = 24 * 1024**2


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = dict.fromkeys(plain)
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordBpe:
    """Words of a text and ids of a word, as the tokenizer file defines them.

    BPE never joins pieces of two words, so a text's ids are its words' ids in a row.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        splitters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self._fast = (
            spec.get("normalizer") == NORMALIZER
            and len(splitters) == 2
            and splitters[0].get("pattern") == {"Regex": SPLIT}
            and splitters[0].get("invert") is True
            and splitters[1].get("use_regex") is False
            and splitters[1].get("add_prefix_space") is False
        )
        letters = _byte_letters()
        self._to_letters = {b: c for b, c in enumerate(letters)}
        self._to_bytes = {ord(c): b for b, c in enumerate(letters)}
        by_id = spec["model"]["vocab"] | self.specials
        found: list[str | None] = [None] * (max(by_id.values()) + 1)
        for piece, i in by_id.items():
            found[i] = piece
        self.pieces = pa.array(found, pa.large_string())

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Loaded where it is needed: workers that only split or decode do without its memory."""
        return Tokenizer.from_file(self.path)

    def __getstate__(self) -> dict:
        """What tasks get: a worker that only splits or decodes need not read the file."""
        return {k: v for k, v in self.__dict__.items() if k != "tokenizer"}

    def words(self, text: str | None) -> list[str]:
        """The words in order; a special token's own string counts as one word."""
        if not text:
            return []
        if self._special and self._special.search(text):
            found = []
            for part in self._special.split(text):
                found += [part] if part in self.specials else self._plain_words(part)
            return found
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str]:
        if self._fast and text.isascii():
            return ASCII_WORDS.findall(text.lower())
        if self._fast and not BEYOND_LATIN.search(text):
            return LATIN_WORDS.findall(text.lower())
        tokenizer = self.tokenizer
        if tokenizer.normalizer is not None:
            text = tokenizer.normalizer.normalize_str(text)
        found = tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [w.translate(self._to_bytes).encode("latin-1").decode("utf-8") for w, _ in found]

    def ids(self, word: str) -> list[int]:
        if word in self.specials:
            return [self.specials[word]]
        letters = word.encode("utf-8").decode("latin-1").translate(self._to_letters)
        return [t.id for t in self.tokenizer.model.tokenize(letters)]


class WordMemo(dict):
    """Ids of words as little-endian 32-bit bytes, remembered up to a number of words."""

    def __init__(self, bpe: WordBpe, limit: int = MEMO_WORDS):
        super().__init__()
        self.bpe, self.limit = bpe, limit

    def __missing__(self, word: str) -> bytes:
        made = np.array(self.bpe.ids(word), "<u4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[word] = made
        return made

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.bpe.words(text)))


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=4)
def word_memo(path: str) -> WordMemo:
    """One memo for each worker process, as it lives longer than a task."""
    return WordMemo(word_bpe(path))


def bundles(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, rows): the rows of ``docs`` as compressed Arrow streams, each of one block."""
    block = fresh(docs, "block")
    names = docs.columns
    # with the split's number, so that a row that repeats in many splits is not in one block
    owner = F.xxhash64(row_key(docs), F.spark_partition_id())
    dealt = docs.withColumn(block, F.pmod(owner, F.lit(n_blocks)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = np.asarray(batch.column(block))
            rows = batch.select(names)
            found = np.unique(owner)
            packed = []
            for b in found:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rows.filter(pa.array(owner == b)))
                packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(packed, pa.binary())], ["block", "rows"])

    return dealt.mapInArrow(run, "block int, rows binary")


def unbundled(rows: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(rows.as_buffer()).read_all()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` (array<int>) in place of the text.

    Rows are dealt to blocks of bounded size by a hash of all their columns and their split. Each block
    names its distinct words. Brought together by word and sorted, these form the table of
    distinct words, in which each word is encoded once, beside the blocks that hold it. A
    union by block brings each block the ids of its words before its texts, and there they are
    put at the words' positions, a slice of rows at a time. Nothing is broadcast, a word occurs at
    most once for each block, and a task holds the words of one block and one slice of its rows.
    One exchange of the texts, compressed, serves both uses.

    Null and empty texts give empty arrays. Rows are kept one by one, repeated rows
    included. A column already called like ``ids`` is replaced. An empty table gives none.
    """
    spark = docs.sparkSession
    docs = without(docs, ids)
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    total = docs.select(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0
    n_blocks = max(spark.sparkContext.defaultParallelism, -(-total // BLOCK_BYTES))
    dealt = bundles(docs, n_blocks).repartition(n_blocks, "block")
    bpe, kind = word_bpe(path), id_type(path)

    def block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, words = bpe.words, None, set()

        def named() -> Iterator[pa.RecordBatch]:
            found = sorted(words)
            words.clear()
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                columns = [pa.array([at] * len(part), pa.int32()), pa.array(part)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "word"])

        for batch in batches:
            for b, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                if b != at:
                    yield from named()
                    at = b
                for t in unbundled(rows).column(text):
                    words.update(split(t.as_py()))
        yield from named()

    def ids_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, last_ids = word_bpe(path), None, b""
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            made = []
            for w in coded.dictionary.to_pylist():
                if w != last:
                    last, last_ids = w, np.array(own.ids(w), kind).tobytes()
                made.append(last_ids)
            taken = pa.array(made, pa.binary()).take(coded.indices)
            columns = [batch.column("block"), batch.column("word"), taken]
            yield pa.RecordBatch.from_arrays(columns, ["block", "word", "word_ids"])

    words_of = dealt.sortWithinPartitions("block").mapInArrow(block_words, "block int, word string")
    table = words_of.repartition("word").sortWithinPartitions("word")
    dictionary = table.mapInArrow(ids_of_words, "block int, word string, word_ids binary").repartition(n_blocks, "block")

    carried = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in carried], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, split, known = np.dtype(kind).itemsize, bpe.words, {}
        get = known.__getitem__
        for batch in batches:  # a block's words come first; a word that is not there stops the job
            entries = batch.filter(batch.column("word").is_valid())
            known.update(zip(entries.column("word").to_pylist(), entries.column("word_ids").to_pylist(), strict=True))
            for rows in batch.column("rows").drop_null():
                whole = unbundled(rows)
                for at in range(0, whole.num_rows, SLICE_ROWS):
                    own = whole.slice(at, SLICE_ROWS)
                    made = [b"".join(map(get, split(t.as_py()))) for t in own.column(text)]
                    lengths = np.fromiter((len(m) // width for m in made), np.int64, len(made))
                    column = list_of(np.frombuffer(b"".join(made), kind).astype(np.int32), lengths)
                    yield pa.table([*[own.column(c) for c in carried], column], names=schema.names).to_batches()[0]
        pa.default_memory_pool().release_unused()

    # both sides are dealt by block alike, so the union is too, and its rows are not moved again
    texts = dealt.select("block", "rows", F.lit(None).cast("string").alias("word"), F.lit(None).cast("binary").alias("word_ids"))
    both = texts.unionByName(dictionary, allowMissingColumns=True).sortWithinPartitions("block", F.col("word").isNull())
    return both.groupBy("block").applyInArrow(put_back, schema)


@lru_cache(maxsize=4)
def id_type(path: str) -> str:
    """How ids are written: 16 bits where they suffice."""
    return "<u2" if len(word_bpe(path).pieces) <= 1 << 16 else "<u4"


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``text`` in place of ``ids``: the pieces, joined by spaces.

    Each id is joined with the id-to-piece table by position, batch by batch; the table is
    the vocabulary, which does not grow with the data. Ids outside it and null ids are left
    out, as the library does; a null or empty array gives an empty text.
    """
    renamed = without(encoded, text)
    known = word_bpe(path).pieces

    def add(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(ids)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = pc.cast(pc.list_flatten(column), pa.int64())
        inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(known)))
        taken = pc.take(known, pc.if_else(inside, flat, pa.scalar(None, pa.int64())))
        if taken.null_count:
            owner = np.repeat(np.arange(len(lengths)), lengths)[pc.is_valid(taken).to_numpy(zero_copy_only=False)]
            lengths, taken = np.bincount(owner, minlength=len(lengths)), pc.drop_null(taken)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), taken)
        return [pc.cast(pc.binary_join(lists, pa.scalar(" ", pa.large_string())), pa.string())]

    return add_columns(renamed, f"`{text}` string", add, drop=(ids,))
