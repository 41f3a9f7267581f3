"""Timestamp and date functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The six timestamp forms of the sources are
#   2020-03-22 23:45:00    2020-03-22 23:45    2020-02-01T11:53:03    2020-02-01T11:53
#   1/22/20 17:00          1/22/2020 17:00
ISO_STAMP = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}(:\d{1,2})?$"
SLASH_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
SLASH_STAMP = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4}) (\d{1,2}:\d{1,2})$"
# Fixed value: two-digit years from 69 on belong to the last century.
FIRST_YEAR_OF_LAST_CENTURY = "69"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
FILE_DATE = r"(\d{2}-\d{2}-\d{4})\.csv"
FILE_DATE_FORMAT = "MM-dd-yyyy"
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"
DATE_TEXT = "yyyy-MM-dd"


def year_first(text: Column, form: str, turned: str) -> Column:
    """Month/day/year text rewritten with the year, in four digits, in front."""
    year = F.regexp_extract(text, form, 3)
    century = F.when(F.length(year) == 4, "").when(year >= FIRST_YEAR_OF_LAST_CENTURY, "19").otherwise("20")
    return F.concat(century, F.regexp_replace(text, form, turned))


def parse_timestamp(text: Column) -> Column:
    """Timestamp without a zone from any of the six forms; null for null or other text.

    Stamps are local times of no known zone, so no hour is moved, whatever the session's zone.

    Slash forms are rewritten to year-month-day first, so that one cast, which is
    much cheaper than a pattern parser, reads every row.
    """
    turned = year_first(text, SLASH_STAMP, "$3-$1-$2 $4")
    iso = F.when(text.rlike(ISO_STAMP), text).when(text.rlike(SLASH_STAMP), turned)
    return iso.try_cast("timestamp_ntz")


def parse_stamp_date(text: Column) -> Column:
    """Date from the same forms, whatever follows the date part, if anything."""
    day = F.get(F.split(text, "[ T]", 2), F.lit(0))
    turned = year_first(day, SLASH_DATE, "$3-$1-$2")
    return F.when(day.rlike(ISO_DATE), day).when(day.rlike(SLASH_DATE), turned).try_cast("date")


def parse_iso_date(text: Column) -> Column:
    """Date from year-month-day text; null when the text is no such date."""
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def timestamp_text(ts: Column) -> Column:
    return F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 19)


def date_text(day: Column) -> Column:
    return F.date_format(day.cast("date"), DATE_TEXT)


def file_date(name: Column) -> Column:
    """Report date from a file name or path holding ``MM-dd-yyyy.csv``."""
    return F.try_to_timestamp(F.regexp_extract(name, FILE_DATE, 1), F.lit(FILE_DATE_FORMAT)).cast("date")


def file_name_for(day: Column) -> Column:
    return F.concat(F.date_format(day, FILE_DATE_FORMAT), F.lit(".csv"))


def time_parts(ts: Column) -> dict[str, Column]:
    """Parts of a timestamp; ISO week, and weekday counted from Monday = 0."""
    return {
        "hour": F.hour(ts),
        "day": F.dayofmonth(ts),
        "week": F.weekofyear(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "weekday": F.weekday(ts),
    }


def days_before(day: Column, n: int) -> Column:
    return F.date_sub(day, n)


def days_after(day: Column, n: int) -> Column:
    return F.date_add(day, n)
