"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_part(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, 1)


def last_part(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, -1)


def contains_any(text: Column, needles: list[str]) -> Column:
    """True where the text contains at least one of the given strings."""
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def splice(text: Column, start: int, length: int, replacement: Column) -> Column:
    """Replace ``length`` characters from 1-based ``start``; the rest stays."""
    return F.overlay(text, replacement, F.lit(start), F.lit(length))


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_blank(text: Column) -> Column:
    """True for null and empty text; written so that it reaches the Parquet scan."""
    return text.isNull() | (text == "")
