"""Language identification by partial matching over bytes.

For each language a byte context tree of up to ``ORDER`` symbols holds the symbols seen
after each context in its labelled rows: in all (``train_on``) or in a bounded sample (``train``). A symbol's probability comes from
the longest context that the language has: n / (N + D) for a symbol seen there n of N times
among D different ones; otherwise D / (N + D), the escape, times its probability in the next
shorter context among the symbols not seen in the longer one. The statistics are frozen, so
a text's code length is the exact sum over its bytes, and the language that codes the text
in the fewest bits is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epimill.llm.common import add_columns, fresh

ORDER = 3
DOCS_PER_LANGUAGE = 400
SPLIT_GROUPS = 256
CHUNK_BYTES = 1 << 20
UNKNOWN = "und"
FREE_BITS = 128  # a short text may hold a name or a number
USUAL_SHARE = 0.99
RATE_SLACK = 2
RATE_STEPS = 256
LEAST_RATE = 1 / 1024


def _classes() -> np.ndarray:
    """Symbol of each byte: letters without case, one for digits, one for the rest, bytes from 128 by themselves."""
    table = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        table[b] = b if b >= 128 else ord(c.lower()) if c.isalpha() else ord("0") if c.isdigit() else ord(" ")
    return table


CLASSES = _classes()
BLANK = ord(" ")
LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and where each row starts; null is empty."""
    column = pa.array(column.fill_null("").to_pylist(), pa.large_string()) if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def _contexts(symbols: np.ndarray, starts: np.ndarray, size: int, blank: int) -> np.ndarray:
    """The ``ORDER`` symbols before each place as one number; before a text there are blanks."""
    code = np.zeros(len(symbols), np.int64)
    for back in range(ORDER, 0, -1):
        before = np.full(len(symbols), blank, np.int64)
        before[back:] = symbols[:-back]
        for i in range(back):
            near = starts + i
            before[near[near < len(symbols)]] = blank
        code = code * size + before
    return code


def hash_sample(labelled: DataFrame, key: Column, language: Column, per_language: int) -> DataFrame:
    """Rows of up to ``per_language`` keys of each language, those with the least hashes.

    Only the keys and languages are ranked, in two steps: each split keeps its least hashes,
    groups of splits theirs, and all groups together the least of those. What goes through the
    driver is one number per language, and the rows are then chosen where they are read.
    """
    ranked = labelled.select(language.alias("language"), F.xxhash64(key).alias("hash"))
    ranked = ranked.withColumn("splits", F.pmod(F.spark_partition_id(), F.lit(SPLIT_GROUPS)))
    for of in (["language", "splits"], ["language"]):
        rank = F.row_number().over(W.partitionBy(*of).orderBy("hash"))
        ranked = ranked.withColumn("rank", rank).filter(F.col("rank") <= per_language).drop("rank")
    last = ranked.groupBy("language").agg(F.max("hash").alias("last"))
    limits = {r["language"]: r["last"] for r in last.collect()}
    if not limits:
        return labelled.limit(0)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[language]
    return labelled.filter(F.xxhash64(key) <= limit)


def count_contexts(rows: DataFrame, text: str, language: str) -> DataFrame:
    """(language, depth, gram, n) over all rows, in 256 symbols.

    Texts are counted in parts of ``CHUNK_BYTES``, and only by their longest contexts: what
    follows a shorter one is the sum over the longer ones that end in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array(batch.column(1).to_pylist(), object)
            for name in sorted(set(languages)):
                values, offsets = _text_bytes(batch.filter(pa.array(languages == name)).column(0))
                for at in range(0, len(values), CHUNK_BYTES):
                    low = max(at - ORDER, 0)
                    symbols = CLASSES[values[low : at + CHUNK_BYTES]]
                    first, last = np.searchsorted(offsets[:-1], (low, low + len(symbols)))
                    full = _contexts(symbols, offsets[first:last] - low, 256, BLANK)
                    grams, n = np.unique((full * 256 + symbols)[at - low :].astype(np.uint32), return_counts=True)
                    columns = [pa.array([name] * len(n), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["language", "gram", "n"])

    chosen = rows.select(F.col(f"`{text}`").cast("string"), F.col(f"`{language}`").cast("string"))
    counted = chosen.mapInArrow(run, "language string, gram long, n long")
    longest = counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    endings = [F.struct(F.lit(k).alias("depth"), F.col("gram").bitwiseAND(F.lit(256 ** (k + 1) - 1)).alias("gram")) for k in range(ORDER + 1)]
    each = longest.select("language", F.explode(F.array(*endings)).alias("ending"), "n")
    return each.groupBy("language", "ending.depth", "ending.gram").agg(F.sum("n").alias("n"))


class SparseRows:
    """A number for some owners of some keys: the owners of a key lie in a row, the keys ascend."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray, value: np.ndarray):
        order = np.lexsort((owner, keys))
        self.keys, starts = np.unique(keys[order], return_index=True)
        self.starts = np.append(starts, len(keys))
        self.owner, self.value = owner[order].astype(np.int32), value[order].astype(np.float32)

    def entries(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``wanted``, owner, value) of all entries of the wanted keys."""
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == wanted)
        first, n = self.starts[at[known]], np.diff(self.starts)[at[known]]
        entry = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.repeat(known, n), self.owner[entry], self.value[entry]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.starts, self.owner, self.value))


class ContextTrees:
    """Frozen code lengths in bits of each symbol after each context, for all languages.

    Only what a language has seen is held: for each depth the bits of its symbols after its contexts,
    and of its escapes. So memory grows with the contexts of the languages, not with
    all contexts of all symbols times languages. What follows a context follows its shorter ones too.
    """

    def __init__(self, languages: list[str], depth: np.ndarray, gram: np.ndarray, owner: np.ndarray, n: np.ndarray):
        self.languages = languages
        seen = np.unique(np.append(gram[depth == 0], BLANK))
        self.size = len(seen) + 1  # the last symbol stands for bytes that the sample lacks
        to_symbol = np.full(256, self.size - 1, np.int64)
        to_symbol[seen] = np.arange(len(seen))
        self.symbol_of_byte = to_symbol[CLASSES]
        self.blank = int(to_symbol[BLANK])
        size, n_languages = self.size, len(languages)
        self.known: list[SparseRows] = []  # by depth: bits of a symbol after a context
        self.escapes: list[SparseRows] = []  # bits from a context to the next shorter one, less those of exclusion
        shorter_key, shorter = np.zeros(0, np.int64), np.zeros(0)  # probabilities one symbol shorter
        for order in range(ORDER + 1):
            own = depth == order
            grams, who, times = gram[own].astype(np.int64), owner[own].astype(np.int64), n[own].astype(np.float64)
            context = np.zeros(len(grams), np.int64)
            for back in range(order, 0, -1):
                context = context * size + to_symbol[(grams >> (8 * back)) & 255]
            symbol = to_symbol[grams & 255]
            nodes, node = np.unique(context * n_languages + who, return_inverse=True)
            total, kinds = np.bincount(node, times, len(nodes)), np.bincount(node, minlength=len(nodes))
            if order:
                suffix = context % size ** (order - 1)
                below = shorter[np.searchsorted(shorter_key, (suffix * size + symbol) * n_languages + who)]
            else:
                below = np.full(len(grams), 1 / size)
            # the symbol that the sample lacks is never seen, so something is left to escape to
            unseen = 1 - np.bincount(node, below, len(nodes))
            share = times / (total + kinds)[node]
            self.known.append(SparseRows(context * size + symbol, who, -np.log2(share)))
            bits = np.log2(total + kinds) - np.log2(kinds) + np.log2(unseen)
            self.escapes.append(SparseRows(nodes // n_languages, nodes % n_languages, bits))
            key = (context * size + symbol) * n_languages + who
            sort = np.argsort(key)
            shorter_key, shorter = key[sort], share[sort]

    @property
    def nbytes(self) -> int:
        return sum(rows.nbytes for rows in (*self.known, *self.escapes))

    def bits_of(self, places: np.ndarray) -> np.ndarray:
        """Bits under each language of a symbol after its context; a place is context times size plus symbol."""
        context, symbol = places // self.size, places % self.size
        bits = np.full((len(places), len(self.languages)), np.log2(self.size), np.float32)
        for order in range(ORDER + 1):
            of = context % self.size**order
            at, owner, escape = self.escapes[order].entries(of)
            bits[at, owner] += escape
            at, owner, own = self.known[order].entries(of * self.size + symbol)
            bits[at, owner] = own
        return bits

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Bits of each text under each language."""
        values, offsets = _text_bytes(column)
        lengths = np.diff(offsets)
        total = np.zeros((len(lengths), len(self.languages)))
        symbols = self.symbol_of_byte[values]
        place = _contexts(symbols, offsets[:-1], self.size, self.blank) * self.size + symbols
        step = max(CHUNK_BYTES // max(1, len(self.languages) // 4), 1)
        for at in range(0, len(place), step):
            # each place is looked up once, in ascending order
            found = pa.array(place[at : at + step]).dictionary_encode()
            places = found.dictionary.to_numpy()
            order = np.argsort(places)
            bits = np.empty((len(places), len(self.languages)), np.float32)
            bits[order] = self.bits_of(places[order])
            part = bits[found.indices.to_numpy()]
            first = np.searchsorted(offsets, at, "right") - 1
            last = np.searchsorted(offsets, at + len(part), "left")
            inside = np.flatnonzero(lengths[first:last]) + first
            cuts = np.maximum(offsets[inside] - at, 0)
            total[inside] += np.add.reduceat(part, cuts, axis=0, dtype=np.float64)
        return total


@lru_cache(maxsize=2)
def _trees(languages: tuple[str, ...], counts: bytes) -> ContextTrees:
    rows = pa.ipc.open_stream(counts).read_all()
    return ContextTrees(list(languages), *(rows.column(c).to_numpy() for c in ("depth", "gram", "owner", "n")))


def usable(rows: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """The rows that can be learned from: those with a text and a label."""
    return rows.filter(F.col(f"`{text}`").isNotNull() & F.col(f"`{language}`").isNotNull())


def labelled_sample(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", per_language: int = DOCS_PER_LANGUAGE
) -> DataFrame:
    """The rows to learn from; those without a text or a label are left out."""
    return hash_sample(usable(labelled, text, language), F.col(f"`{key}`"), F.col(f"`{language}`").cast("string"), per_language)


def train(
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    per_language: int = DOCS_PER_LANGUAGE,
) -> tuple[tuple[str, ...], bytes]:
    """Context counts of the languages, from at most ``per_language`` documents of each.

    Rows without a text or a label are left out. The sample, and so the model that goes to
    the driver and the executors, does not grow with the data.
    """
    return train_on(labelled_sample(labelled, key, text, language, per_language), text, language)


def train_on(labelled: DataFrame, text: str = "text", language: str = "lang") -> tuple[tuple[str, ...], bytes]:
    """Context counts of the languages, from all rows.

    What comes to the driver is a number for each context and symbol that a language has, not
    for each row: of ASCII texts at most 28^4 of the longest for a language, however many rows there are.
    """
    rows = count_contexts(labelled, text, language).toArrow()
    languages = tuple(sorted(pc.unique(rows.column("language")).to_pylist()))
    owner = pc.index_in(rows.column("language"), pa.array(languages, pa.string()))
    packed = pa.table({
        "depth": rows.column("depth").cast(pa.uint8()), "gram": rows.column("gram").cast(pa.uint32()),
        "owner": owner.cast(pa.uint16()), "n": rows.column("n"),
    }).sort_by([(c, "ascending") for c in ("owner", "depth", "gram")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, packed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(packed)
    return languages, sink.getvalue().to_pybytes()


def rate_bounds(rated: DataFrame, rates: tuple[str, ...], predicted: str = "lang_pred") -> list[float]:
    """For each of these rates of ``predict``, the most of a text in a learned language.

    Twice what nearly all of the rows need, so that what is unusual but written in the
    language stays; 0 if no row has a letter. All rows are counted, by steps of their rate
    of which there are ``RATE_STEPS`` to a power of two, so few numbers are held.
    """
    lettered = rated.filter(F.col(f"`{predicted}`") != UNKNOWN)
    steps = [F.ceil(RATE_STEPS * F.log2(F.greatest(F.col(f"`{r}`"), F.lit(LEAST_RATE)))).alias(f"step_{i}") for i, r in enumerate(rates)]
    share = f"percentile_disc({USUAL_SHARE}) WITHIN GROUP (ORDER BY step_"
    usual = lettered.select(*steps).select(*[F.expr(f"{share}{i})") for i in range(len(rates))]).first()
    none = RATE_STEPS * np.log2(LEAST_RATE)
    return [0.0 if u is None or u <= none else RATE_SLACK * 2 ** (u / RATE_STEPS) for u in usual]


def predict(
    docs: DataFrame,
    model: tuple[tuple[str, ...], bytes],
    text: str = "text",
    predicted: str = "lang_pred",
    score: str = "score",
    rates: tuple[str, ...] = (),
) -> DataFrame:
    """``docs`` with the predicted language and its share of the probability, from 0 to 1.

    The score is 2^-bits of the best language over the sum for all languages; ties go to the
    first name. A text that is null or has no letter, and any text where nothing was learned,
    is ``und`` with score 0. Columns of those names are replaced. ``rates`` names two more
    columns: bits of the best language, less the first ``FREE_BITS``, per byte and per byte
    of letters. The score only compares languages; the rates say whether the text is in any.
    """
    languages, counts = model
    lettered = fresh(docs, "lettered")
    marked = docs.withColumn(lettered, F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))

    def add(batch: pa.RecordBatch) -> list[pa.Array]:
        names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        found = [np.zeros(batch.num_rows) for _ in rates]
        usable = np.asarray(batch.column(lettered))
        if languages and usable.any():
            bits = _trees(languages, counts).code_lengths(batch.column(text))
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            names = [languages[b] if u else UNKNOWN for b, u in zip(best, usable, strict=True)]
            scores = np.where(usable, share, 0.0)
            if rates:
                values, offsets = _text_bytes(batch.column(text))
                letters = np.diff(np.r_[0, np.cumsum(LETTERS[values])][offsets])
                found = [np.where(usable, (bits.min(1) - FREE_BITS) / np.maximum(n, 1), 0.0) for n in (np.diff(offsets), letters)]
        return [pa.array(names, pa.string()), pa.array(scores), *map(pa.array, found)]

    made = ", ".join([f"`{predicted}` string", f"`{score}` double", *[f"`{r}` double" for r in rates]])
    return add_columns(marked, made, add, drop=(lettered,))


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    per_language: int = DOCS_PER_LANGUAGE,
) -> DataFrame:
    """Predictions for ``docs`` by a model of ``labelled``; see ``train`` and ``predict``."""
    return predict(docs, train(labelled, key, text, language, per_language), text)
