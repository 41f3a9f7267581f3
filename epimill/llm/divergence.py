"""Divergence of each source from the others of its language, in whole numbers.

A language's kept terms are rows and its sources columns of a table of counts. The distance of
two sources sums a price over all terms, which depends on the two counts alone; so it follows
from how many terms have each pair of counts. Blocks of terms become indicator matrices with
one column for each (source, count) that occurs. The product of such a matrix's transpose with
another holds the joint table of every pair of sources at once, as exact whole numbers; its
entries are priced and summed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epimill.llm.common import grouped, stored

MIN_DOCUMENTS = 10
SHOWN = 10
UNIT = 1_000_000_000
SMOOTHING = 2
HELD_TERMS = 400_000
BLOCK_CELLS = 1 << 18
BLOCK_TERMS = 1 << 13
TILE = 128
CHUNK_TERMS = 1 << 11
MOST_COLUMNS = 1_200
LEAST_TERMS = 16
# terms are runs of bytes other than these; only A to Z are lower-cased
_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
TERM_BYTES = bytes((b | 0x20 if b < 0x5B else b) if b in _LETTERS else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): occurrences and documents of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        found: dict[tuple, tuple[Counter, Counter]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                every = list(n)
                for at in range(0, len(every), 20_000):
                    terms = every[at : at + 20_000]
                    columns = [
                        pa.array([lang] * len(terms), pa.string()),
                        pa.array([source] * len(terms), pa.string()),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in terms], pa.int64()),
                        pa.array([docs[t] for t in terms], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)
            found.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                terms = terms_of(text.as_buffer().to_pybytes())
                if terms:
                    n, in_docs = found.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                    n.update(terms)
                    in_docs.update(set(terms))
            if sum(len(n) for n, _ in found.values()) >= HELD_TERMS:
                yield from counted()
        yield from counted()

    made = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * size)), by long division, which stays in 64 bits."""
    over = total + SMOOTHING * size
    rest, value = count + SMOOTHING, F.lit(0).cast("long")
    for _ in range(3):  # three steps of a thousand make UNIT
        rest = rest * 1000
        value, rest = value * 1000 + _div(rest, over), F.pmod(rest, over)
    return value + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q))."""
    return _div((p - q) * (p - q), p + q)


def _shares(count: np.ndarray, total: np.ndarray, size: np.ndarray) -> np.ndarray:
    over, rest, value = total + SMOOTHING * size, count + SMOOTHING, np.zeros(len(count), np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, over)
        value = value * 1000 + whole
    return value + 1


def joint_price(counts: np.ndarray, side: np.ndarray, total: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
    """Add to ``out`` the price of each pair of columns of ``counts``, summed over its rows.

    counts: terms by sources. side: whether a source is on the left, the right or both (0, 1,
    2) of the pairs; of two on both sides the first is the left one.
    """
    n, sources = counts.shape
    level = np.arange(sources, dtype=np.int64)[None, :] * (int(counts.max(initial=0)) + 1) + counts
    columns, at = np.unique(level, return_inverse=True)
    if len(columns) > MOST_COLUMNS and n > LEAST_TERMS:
        half = n // 2
        joint_price(counts[:half], side, total, size, out)
        joint_price(counts[half:], side, total, size, out)
        return
    source, value = np.divmod(columns, int(counts.max(initial=0)) + 1)
    shown = np.zeros((n, len(columns)), np.float32)  # whole numbers up to 2 ** 24 are exact
    shown[np.arange(n)[:, None], at.reshape(n, sources)] = 1
    left, right = np.flatnonzero(side[source] != 1), np.flatnonzero(side[source] != 0)
    joint = shown[:, left].T @ shown[:, right]
    i, j = np.nonzero(joint)
    times = joint[i, j].astype(np.int64)
    i, j = left[i], right[j]
    own = (source[i] < source[j]) if side.max(initial=0) == 2 else np.ones(len(i), bool)
    i, j, times = i[own], j[own], times[own]
    p = _shares(value, total[source], size[source])
    gap = p[i] - p[j]
    np.add.at(out, (source[i], source[j]), times * (gap * gap // (p[i] + p[j])))


def pair_prices(terms: DataFrame, groups: DataFrame, block_terms: int, n_tiles: int) -> DataFrame:
    """(lang, source, item, value): the price of each pair of sources of a language, both ways round.

    terms: (lang, term, counts). groups: (lang, source, number, total, size). A task has one
    block of a language's terms and two tiles of its sources; tiles pair up so that each two
    sources meet in one pair of tiles.
    """
    n_blocks = max(1, -(-terms.count() // block_terms))
    tiles = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(n_tiles) for b in range(a, n_tiles)])
    ).alias("tiles")
    block = F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int").alias("block")
    rows = terms.select("lang", block, tiles, "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("sum"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    tile = F.col("number") % n_tiles
    sides = groups.select("lang", "source", "number", "total", "size", tile.alias("tile"), tiles)
    sides = sides.filter(F.col("tile").isin(F.col("tiles.a"), F.col("tiles.b")))
    side = F.when(F.col("tiles.a") == F.col("tiles.b"), 2).when(F.col("tile") == F.col("tiles.a"), 0).otherwise(1)
    sides = sides.select("lang", all_blocks, "tiles", "source", "number", "total", "size", side.alias("side"))
    both = rows.withColumn("number", F.lit(None).cast("int")).unionByName(sides, allowMissingColumns=True)
    both = both.withColumn("a", F.col("tiles.a")).withColumn("b", F.col("tiles.b")).drop("tiles")
    at = ["lang", "block", "a", "b"]
    # sources first, then terms by how frequent they are, so that a part of a block has few different counts
    dealt = both.repartition(*at).sortWithinPartitions(*at, F.col("number").asc_nulls_last(), "sum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "item", "value"]
        for (lang, *_), block in grouped(batches, *at):
            is_term = np.asarray(block.column("number").is_null())
            n_sources = int(len(is_term) - is_term.sum())
            here, rows = block.slice(0, n_sources), block.slice(n_sources)
            if n_sources < 2 or not rows.num_rows:
                continue
            source = here.column("source").combine_chunks()
            side, total, size = (np.asarray(here.column(c)).astype(np.int64) for c in ("side", "total", "size"))
            out = np.zeros((n_sources, n_sources), np.int64)
            for part in rows.select(["counts"]).to_batches(max_chunksize=CHUNK_TERMS):
                lists = part.column("counts")
                lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                place = pc.index_in(flat.field("source"), source)
                known = np.asarray(place.is_valid())
                term = np.repeat(np.arange(len(lists)), lengths)[known]
                counts = np.zeros((len(lists), n_sources), np.int64)
                counts[term, np.asarray(place.drop_null())] = np.asarray(flat.field("n"))[known]
                joint_price(counts, side, total, size, out)
            i, j = np.nonzero(out)
            names_of = source.take(pa.array(np.r_[i, j])), source.take(pa.array(np.r_[j, i]))
            columns = [pa.array([lang] * (2 * len(i)), pa.string()), *names_of, pa.array(np.r_[out[i, j], out[i, j]])]
            yield pa.RecordBatch.from_arrays(columns, names)

    parts = dealt.mapInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    shown: int = SHOWN,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language.

    Terms are runs of ASCII letters and of characters beyond ASCII, ``A`` to ``Z`` lower-cased. A
    language keeps those in at least ``min_documents`` of its documents. A group's share of a
    term is 1 + floor(10^9 (count + 2) / (N + 2 V)), for V kept terms and N occurrences of them;
    a price is floor((p - q)^2 / (p + q)). Part ``pair`` has the price summed over all kept terms
    against each other source of the language; part ``term`` the ``shown`` terms of highest price
    that the source uses more than its language does. Ties go to the smaller text, by bytes.

    Null texts, languages and sources are read as empty. Every (lang, source) that occurs takes
    part, also without terms. Repeated rows are documents of their own; other columns are not
    read. An empty table gives no rows. Terms are counted in each task and by (lang, source, term) before they
    are brought together, so a hot source is a sum of partial counts; a block of terms and a pair of tiles of
    sources is all that a task holds. The pairs of a language's sources are the result itself.
    """
    chosen = docs.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))],
        F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "utf-8").alias("text"),
    )
    counted = stored(term_counts(chosen), "term-counts", compression="zstd")
    entry = F.struct("source", "n")
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(entry).alias("counts"))
    terms = stored(by_term.filter(F.col("docs") >= min_documents).drop("docs"), "kept-terms", compression="zstd")

    each = terms.select("lang", "term", F.explode("counts").alias("c")).select("lang", "term", "c.*")
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("size"))
    whole = W.partitionBy("lang")
    groups = chosen.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select(
        "lang",
        "source",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("size", F.lit(0)).alias("size"),
        (F.row_number().over(whole.orderBy("source")) - 1).alias("number"),
        F.sum(F.coalesce("total", F.lit(0))).over(whole).alias("in_lang"),
    )
    groups = stored(groups, "groups")
    most = (groups.select(F.max("number")).first()[0] or 0) + 1
    n_tiles = -(-most // TILE)
    block_terms = max(64, min(BLOCK_TERMS, BLOCK_CELLS // most))

    value = F.coalesce("value", F.lit(0)).alias("value")
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").filter(F.col("source") != F.col("item"))
    pairs = pairs.join(pair_prices(terms, groups, block_terms, n_tiles), ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value)

    in_lang = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    used = terms.select("lang", "term", in_lang.alias("of_lang"), F.explode("counts").alias("c")).select("*", "c.source", "c.n")
    used = used.join(groups.drop("number"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("size")), share(F.col("of_lang"), F.col("in_lang"), F.col("size"))
    used = used.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    used = used.select("lang", "source", F.lit("term").alias("part"), "item", price(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    best = used.select("*", rank).filter(F.col("rank") <= shown)
    return pairs.select("*", rank).unionByName(best)
