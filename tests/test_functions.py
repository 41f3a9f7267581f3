import datetime as dt

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from epimill.functions import dates, numbers, texts

STAMPS = {
    "2020-03-22 23:45:00": "2020-03-22 23:45:00",
    "2020-03-22 23:45": "2020-03-22 23:45:00",
    "2020-02-01T11:53:03": "2020-02-01 11:53:03",
    "2020-02-01T11:53": "2020-02-01 11:53:00",
    "1/22/20 17:00": "2020-01-22 17:00:00",
    "1/22/2020 17:00": "2020-01-22 17:00:00",
    "12/31/68 23:59": "2068-12-31 23:59:00",
    "1/1/69 0:05": "1969-01-01 00:05:00",
    "2/29/72 1:00": "1972-02-29 01:00:00",
    "2/29/2021 1:00": None,
    "13/1/2020 1:00": None,
    "2020-03-22": None,
    "2020-03-22 25:00": None,
    "2020-03-22 23:45:00.5": None,
    "junk": None,
    "": None,
    None: None,
}


def test_six_stamp_forms(spark):
    df = spark.createDataFrame([(text,) for text in STAMPS], "text string")
    parsed = df.select("text", dates.timestamp_text(dates.parse_timestamp(F.col("text"))).alias("ts"))
    assert {row["text"]: row["ts"] for row in parsed.collect()} == STAMPS


def test_stamp_dates_need_no_time(spark):
    cases = {
        "2020-03-22 23:45:00": "2020-03-22", "2020-02-01T11:53": "2020-02-01", "2020-02-01": "2020-02-01",
        "1/22/20 17:00": "2020-01-22", "1/22/2020": "2020-01-22", "1/2/99": "1999-01-02",
        "2020-02-30 1:00": None, "2/30/20": None, "junk": None, "": None, None: None,
    }
    df = spark.createDataFrame([(text,) for text in cases], "text string")
    got = df.select("text", dates.date_text(dates.parse_stamp_date(F.col("text"))).alias("day"))
    assert {row["text"]: row["day"] for row in got.collect()} == cases


def test_two_digit_years_match_strptime(spark):
    texts_ = [f"3/4/{year:02d} 5:06" for year in range(100)]
    df = spark.createDataFrame([(text,) for text in texts_], "text string")
    got = dict(
        df.select("text", dates.timestamp_text(dates.parse_timestamp(F.col("text")))).collect()
    )
    for text in texts_:
        assert got[text] == dt.datetime.strptime(text, "%m/%d/%y %H:%M").strftime("%Y-%m-%d %H:%M:%S")


def test_time_parts_match_pandas(spark):
    stamps = pd.date_range("2019-12-25 03:00", periods=800, freq="31h")
    df = spark.createDataFrame([(str(ts),) for ts in stamps], "text string")
    ts = dates.parse_timestamp(F.col("text"))
    got = df.select("text", *[part.alias(name) for name, part in dates.time_parts(ts).items()])
    found = {row["text"]: tuple(row)[1:] for row in got.collect()}
    for stamp in stamps:
        expected = (stamp.hour, stamp.day, stamp.isocalendar().week, stamp.month, stamp.year, stamp.weekday())
        assert found[str(stamp)] == expected


@pytest.mark.parametrize(
    ("name", "day"),
    [
        ("03-22-2020.csv", dt.date(2020, 3, 22)),
        ("/land/report=03-22-2020.csv/part-0.csv", dt.date(2020, 3, 22)),
        ("13-22-2020.csv", None),
        ("Israel.csv", None),
        (None, None),
    ],
)
def test_file_date(spark, name, day):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(dates.file_date(F.col("name"))).first()[0] == day


def test_iso_dates_and_shifts(spark):
    df = spark.createDataFrame([("2020-03-01",), ("2020-02-30",), ("x",), (None,)], "t string")
    day = dates.parse_iso_date(F.col("t"))
    got = rows(df.select("t", dates.date_text(dates.days_before(day, 7)), dates.date_text(dates.days_after(day, 1))))
    assert ("2020-03-01", "2020-02-23", "2020-03-02") in got
    assert all(row[1] is None for row in got if row[0] != "2020-03-01")


def test_whole_number_is_half_even(spark):
    cases = {
        "12.0": 12, "2.5": 2, "3.5": 4, "-0.5": 0, "0.5": 0, "1.5": 2, "7": 7,
        "1e3": 1000, "": None, "nan": None, "NaN": None, "x": None, None: None,
    }
    df = spark.createDataFrame([(text,) for text in cases], "t string")
    got = {row[0]: row[1] for row in df.select("t", numbers.whole_number(F.col("t"))).collect()}
    assert got == cases
    for text, value in cases.items():
        if value is not None:
            assert int(f"{float(text):.0f}") == value


def test_ratio_of_zero_and_null(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (1, None), (None, 2)], "a int, b int")
    assert rows(df.select("a", "b", numbers.ratio(F.col("a"), F.col("b"), 100))) == rows(
        spark.createDataFrame(
            [(1, 2, 50.0), (1, 0, None), (1, None, None), (None, 2, None)], "a int, b int, r double"
        )
    )


def test_log10_of_non_positive_is_null(spark):
    df = spark.createDataFrame([(1000.0,), (0.0,), (-5.0,)], "x double")
    assert rows(df.select("x", numbers.log10_positive(F.col("x")))) == [(-5.0, None), (0.0, None), (1000.0, 3.0)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("folder/06-01-2021.csv",)], "t string")
    got = df.select(
        texts.last_part(F.col("t"), "/"),
        texts.first_part(F.col("t"), "/"),
        texts.splice(F.col("t"), 1, 6, F.lit("x")),
        texts.contains_any(F.col("t"), ["zz", "2021"]),
        texts.contains_any(F.col("t"), []),
    ).first()
    assert tuple(got) == ("06-01-2021.csv", "folder", "x/06-01-2021.csv", True, False)


def test_stamps_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2020-03-08 02:30:00",)], "text string")
        ts = dates.parse_timestamp(F.col("text"))
        assert df.select(dates.timestamp_text(ts), dates.time_parts(ts)["hour"]).first() == ("2020-03-08 02:30:00", 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
