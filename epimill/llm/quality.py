"""Quality rules on lines first: failing lines go, then documents that lost too much text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epimill.llm.common import add_columns

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOSS = 0.5
MAX_SYMBOLS_PER_WORD = 0.3
NAVIGATION_SEPARATORS = 3

# How a sentence may end, what divides menu entries, and what pages repeat.
SENTENCE_END = re.compile(r"[.!?…:;][\"'”’»)\]]*\s*$")
SEPARATOR = re.compile(r"\s[|»›>·•]\s")
BOILERPLATE = re.compile(
    r"all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|accept cookies|"
    r"enable javascript|javascript is disabled|click here|sign up for|subscribe to our|lorem ipsum",
    re.IGNORECASE,
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first one included.

    Windows are numbered exactly, by doubling: equal numbers mean equal words.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    code = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        pair = code[: len(code) - step] * (int(code.max()) + 1) + code[step:]
        code = np.unique(pair, return_inverse=True)[1]
        length += step
    repeated = np.flatnonzero(np.bincount(code)[code] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, repeated, 1)
    np.add.at(covered, repeated + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def line_fails(line: str) -> bool:
    """Whether a line is no running text: no sentence end, many symbols, a menu, or boilerplate."""
    if not SENTENCE_END.search(line) or len(SEPARATOR.findall(line)) >= NAVIGATION_SEPARATORS:
        return True
    symbols = sum(line.count(chr(s)) for s in SYMBOLS)
    return symbols > MAX_SYMBOLS_PER_WORD * len(line.split()) or bool(BOILERPLATE.search(line))


def word_characters(text: str) -> int:
    data = text.encode("utf-8")
    return len(text) - len(data) + sum(map(len, data.split()))


def assess(text: str | None) -> tuple[int, int, int, int, int, bool, bool, str]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean text)."""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()  # bytes: only ASCII blanks divide words
    word_chars = word_characters(text)
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = text.split("\n")
    worded = [line for line in lines if line.encode("utf-8").strip()]
    n_repeat = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words)
    failing = {line for line in worded if line_fails(line)}
    lost = sum(word_characters(line) for line in worded if line in failing)
    kept = not base_failed and lost <= MAX_LOSS * word_chars
    clean = "\n".join(line for line in lines if line not in failing)
    return len(words), word_chars, n_symbols, len(worded) - len(set(worded)), n_repeat, base_failed, kept, clean


COLUMNS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
    ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("clean_text", "string"),
]
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def rate(docs: DataFrame, text: str = "text", with_clean: bool = True) -> DataFrame:
    """``docs`` with counts, verdict and, if wanted, the cleaned text in place of the text.

    A document fails the base rules with fewer than 20 words or more than 30 % of its words
    in repeated 8-word windows. Otherwise its lines are judged one by one, failing lines are
    removed, and it is kept unless more than half of its word characters went with them.
    Null and empty texts have no words and fail. Each row is judged by itself, whatever its
    other columns; columns named like the new ones are replaced.
    """
    columns = COLUMNS if with_clean else COLUMNS[:-1]

    def add(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [assess(t.as_py())[: len(columns)] for t in batch.column(text)]
        values = zip(*rows, strict=True) if rows else [[]] * len(columns)
        return [pa.array(v, ARROW[kind]) for v, (_, kind) in zip(values, columns, strict=True)]

    ddl = ", ".join(f"{name} {kind}" for name, kind in columns)
    return add_columns(docs.withColumn(text, F.col(f"`{text}`").cast("string")), ddl, add, drop=(text,))
