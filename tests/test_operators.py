import random

import numpy as np
import pandas as pd
import pytest
from conftest import plan_of, rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from epimill.operators import groups, joins, metrics, series, shape

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
values = st.lists(st.one_of(st.none(), st.integers(-50, 200)), min_size=1, max_size=30)


def series_frame(spark, data):
    """Rows (k, d, x) in shuffled order from key → list of values."""
    triples = [(key, f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", x) for key, xs in data.items() for i, x in enumerate(xs)]
    random.Random(1).shuffle(triples)
    return spark.createDataFrame(triples, "k string, d string, x bigint").repartition(3)


def pandas_frame(data):
    return {key: pd.Series(xs, dtype="float64") for key, xs in data.items()}


def by_key(df, column):
    got = {}
    for row in sorted(df.collect(), key=lambda row: row["d"]):
        got.setdefault(row["k"], []).append(row[column])
    return got


def same(found, expected):
    for key, want in expected.items():
        for ours, theirs in zip(found[key], want, strict=True):
            assert (ours is None) == pd.isna(theirs)
            assert ours is None or ours == pytest.approx(theirs, rel=1e-9, abs=1e-9)


@SLOW
@given(st.fixed_dictionaries({"a": values, "b": values}))
def test_series_match_pandas(spark, data):
    keys, order = ["k"], "d"
    frame = series_frame(spark, data)
    frame = frame.withColumn("delta", series.delta(F.col("x"), keys, order))
    frame = frame.withColumn("clean", series.null_if_negative(F.col("delta")))
    frame = frame.withColumns(
        {
            "min1": series.rolling_mean(F.col("clean"), keys, order),
            "min7": series.rolling_mean(F.col("clean"), keys, order, 7, 7),
        }
    )
    frame = series.add_ewm_means(frame, {"ewm": "delta", "ewm_x": "x"}, keys, order, 0.2).cache()
    deltas = {key: xs.diff().fillna(0) for key, xs in pandas_frame(data).items()}
    clean = {key: xs.where(xs >= 0) for key, xs in deltas.items()}
    same(by_key(frame, "delta"), deltas)
    same(by_key(frame, "clean"), clean)
    same(by_key(frame, "min1"), {k: xs.rolling(7, min_periods=1).mean() for k, xs in clean.items()})
    same(by_key(frame, "min7"), {k: xs.rolling(7, min_periods=7).mean() for k, xs in clean.items()})
    same(by_key(frame, "ewm"), {k: xs.ewm(alpha=0.2).mean() for k, xs in deltas.items()})
    same(by_key(frame, "ewm_x"), {k: xs.ewm(alpha=0.2).mean() for k, xs in pandas_frame(data).items()})
    frame.unpersist()


@pytest.mark.parametrize("alpha", [0.02, 0.2, 0.9])
def test_long_weighted_mean_matches_pandas(spark, alpha):
    draw = random.Random(7)
    xs = [draw.choice([None, 0, draw.randint(-10**6, 10**9)]) for _ in range(3000)]
    frame = spark.createDataFrame([("a", f"{i:06d}", x) for i, x in enumerate(xs)], "k string, d string, x bigint")
    found = by_key(series.add_ewm_means(frame, {"e": "x"}, ["k"], "d", alpha), "e")
    expected = pd.Series(xs, dtype="float64").ewm(alpha=alpha).mean()
    for ours, theirs in zip(found["a"], expected, strict=True):
        assert (ours is None) == pd.isna(theirs)
        assert ours is None or ours == pytest.approx(theirs, rel=1e-9, abs=1e-3)


@pytest.mark.parametrize(("alpha", "nulls"), [(0.2, 600), (0.9, 5000), (1, 600)])
def test_weighted_mean_keeps_its_history_over_nulls(spark, alpha, nulls):
    xs = [5.0, 7.0, *[None] * nulls, 9.0, None]
    frame = spark.createDataFrame([("a", f"{i:06d}", x) for i, x in enumerate(xs)], "k string, d string, x double")
    found = by_key(series.add_ewm_means(frame, {"e": "x"}, ["k"], "d", alpha), "e")
    assert found["a"] == pytest.approx(list(pd.Series(xs).ewm(alpha=alpha).mean()), rel=1e-12)


def test_weighted_mean_rejects_bad_alpha(spark):
    for alpha in (0, 1.5):
        with pytest.raises(ValueError, match="alpha"):
            series.add_ewm_means(spark.range(1), {"e": "id"}, ["id"], "id", alpha)


def test_cumulative_drop_becomes_null(spark):
    frame = series_frame(spark, {"fr": [100, 130, 120, 150]})
    frame = frame.withColumn("delta", series.delta(F.col("x"), ["k"], "d"))
    frame = frame.withColumn("clean", series.null_if_negative(F.col("delta")))
    assert by_key(frame, "delta") == {"fr": [0, 30, -10, 30]}
    assert by_key(frame, "clean") == {"fr": [0, 30, None, 30]}


def test_outliers(spark):
    df = spark.createDataFrame(
        [(1, 30.0, 10.0), (2, 19.0, 1.0), (3, -30.0, 10.0), (4, None, 1.0), (5, 30.0, None), (6, 20.0, 10.0)],
        "i int, v double, s double",
    )
    assert rows(series.drop_outliers(df, [("v", "s")], 2.0, 20.0), "i") == [(2,), (4,), (5,), (6,)]
    assert len(rows(series.drop_outliers(df, [("v", "s")]), "i")) == 6


def test_latest_rows_keep_ties_and_last_row_does_not(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 5, "w"), (None, 1, "n")], "k string, d int, v string"
    )
    assert rows(series.latest_rows(df, ["k"], "d"), "v") == [("n",), ("w",), ("y",), ("z",)]
    assert rows(series.last_row(df, ["k"], "d", "v"), "v") == [("n",), ("w",), ("z",)]
    assert "WindowGroupLimit" in plan_of(series.latest_rows(df, ["k"], "d"))


def test_first_per_key_keeps_first_and_reduces_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), (None, 3, "null")], "k string, o int, v string")
    kept = shape.first_per_key(df, ["k"], ["o"])
    assert rows(kept, "v") == [("early",), ("null",)]
    plan = plan_of(kept)
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_members(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert len(rows(shape.keep_members(df, "k", "all"))) == 3
    assert rows(shape.keep_members(df, "k", "a")) == [("a",)]
    assert rows(shape.keep_members(df, "k", ["b", "c"])) == [("b",)]
    assert rows(shape.keep_members(df, "k", [])) == []
    many = [str(i) for i in range(2000)] + ["b"]
    assert rows(shape.keep_members(df, "k", many)) == [("b",)]
    numbers = spark.range(3).withColumnRenamed("id", "n")
    assert rows(shape.keep_members(numbers, "n", list(range(1, 2000)))) == [(1,), (2,)]
    for more in ([], [float(i) for i in range(10, 2000)]):
        assert rows(shape.keep_members(numbers, "n", [1.5, 2.0, *more])) == [(2,)]


def test_area_level_keeps_null_and_blank(spark):
    df = spark.createDataFrame([("fr", None), ("us", ""), ("us", "Ohio")], "c string, p string")
    assert rows(shape.area_level(df, "p", ["c"])) == [("fr",), ("us",)]


def test_drop_null_also_drops_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert rows(shape.drop_null(df, "x")) == [(1.0,)]
    assert rows(shape.null_nans(df, ["x"])) == [(1.0,), (None,), (None,)]


def test_stamp_corrections(spark):
    df = spark.createDataFrame(
        [
            ("06-01-2021.csv", "Nebraska", "2021-06-01 04:21:00"),
            ("06-01-2021.csv", "Ohio", "2021-06-01 04:21:00"),
            ("06-02-2021.csv", "Nebraska", "2021-06-01 04:21:00"),
            ("06-12-2021.csv", "Florida", "2021-06-12 04:21:00"),
            ("06-12-2021.csv", "Florida", "2021-06-13 04:21:00"),
            ("06-12-2021.csv", None, None),
        ],
        "source_file string, province_state string, last_update string",
    )
    fixes = shape.corrections_table(spark, shape.STAMP_CORRECTIONS)
    got = rows(shape.correct_stamps(df, fixes))
    assert ("06-01-2021.csv", "Nebraska", "2021-06-02 04:21:00") in got
    assert ("06-01-2021.csv", "Ohio", "2021-06-01 04:21:00") in got
    assert ("06-02-2021.csv", "Nebraska", "2021-06-01 04:21:00") in got
    assert got.count(("06-12-2021.csv", "Florida", "2021-06-13 04:21:00")) == 2
    assert ("06-12-2021.csv", None, None) in got
    assert "BroadcastHashJoin" in plan_of(shape.correct_stamps(df, fixes))


def test_several_corrections_for_one_file_and_area(spark):
    df = spark.createDataFrame(
        [("f", "a", "2021-06-01 04:21"), ("f", "a", "2021-06-03 04:21")], "source_file string, province_state string, last_update string"
    )
    fixes = shape.corrections_table(spark, [("f", "a", "2021-06-01", "2021-06-02"), ("f", "a", "2021-06-03", "2021-06-04")])
    assert rows(shape.correct_stamps(df, fixes), "last_update") == [("2021-06-02 04:21",), ("2021-06-04 04:21",)]
    with pytest.raises(ValueError, match="two corrections"):
        shape.corrections_table(spark, [("f", "a", "2021-06-01", "2021-06-02")] * 2)


def test_lookup_with_a_repeated_key_stops_the_join(spark):
    lookup = spark.createDataFrame([("fr", 1), ("us", 2), (None, 3), (None, 4)], "k string, n int")
    assert joins.one_per_key(lookup, "k").count() == 4
    doubled = joins.one_per_key(lookup.union(lookup.where("k = 'us'")), "k")  # no job until the rows are asked for
    facts = spark.createDataFrame([("us", 7), (None, 8)], "k string, m int")
    for query in (doubled, joins.add_lookup(facts, doubled, "k")):
        with pytest.raises(Exception, match="several lookup rows with k us"):
            query.collect()


def test_unreadable_stamps_are_spread(spark):
    stamps = [None if i % 3 == 0 else "no stamp" if i % 3 == 1 else "2021-01-02 03:04:05" for i in range(900)]
    facts = spark.createDataFrame(list(enumerate(stamps)), "id int, last_update string")
    times = spark.createDataFrame([("2021-01-02 03:04:05", 2021)], "last_update string, year int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.add_time_parts(facts, times).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    unread = [row["part"] for row in joined if row["year"] is None]
    assert len(unread) == 600 and max(map(unread.count, set(unread))) < 200
    assert sum(row["year"] == 2021 for row in joined) == 300


def test_weighted_means_with_long_gaps(spark):
    values = [5.0, 7.0] + [None] * 700 + [1.0] + [None] * 400 + [3.0, None] * 200 + [None] * 5_000 + [2.0, 9.0]
    data = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    got = [row["m"] for row in series.add_ewm_means(data, {"m": "v"}, ["k"], "i").orderBy("i").collect()]
    want = pd.Series(values, dtype=float).ewm(alpha=0.2, adjust=True, ignore_na=False).mean()
    assert np.allclose(np.array(got[:1_500], dtype=float), want[:1_500], rtol=1e-12)
    assert got[1_502] == pytest.approx(got[-3]) == pytest.approx(3.0, rel=1e-12)  # the last mean stays over 5,000 nulls
    assert got[-2] == pytest.approx(2.0) and got[-1] == pytest.approx((2.0 * 0.8 + 9.0) / 1.8)


def test_sorted_reads(spark):
    df = spark.createDataFrame([(1, "a"), (3, "c"), (2, "b")], "d int, v string")
    assert [row["v"] for row in shape.last_rows(df, 2, "d").collect()] == ["c", "b"]
    assert [row["v"] for row in shape.first_rows(df, 2, "d").collect()] == ["a", "b"]
    assert "TakeOrderedAndProject" in plan_of(shape.last_rows(df, 2, "d"))


def test_merge_lookups_matches_null_with_null(spark):
    left = spark.createDataFrame([("fr", 1), ("us", 2), ("us", 3), (None, 4)], "c string, u int")
    right = spark.createDataFrame([("us", "l1"), ("de", "l2"), (None, "l3")], "c string, l string")
    merged = joins.merge_lookups(left, right, "c")
    pandas_result = left.toPandas().merge(right.toPandas(), on="c", how="outer")
    expected = [
        tuple(None if pd.isna(v) else v for v in row) for row in pandas_result[["c", "u", "l"]].itertuples(index=False)
    ]
    assert rows(merged, "c", "u", "l") == sorted(
        ((c, None if u is None else int(u), l) for c, u, l in expected), key=repr
    )


def test_second_fact_ignores_blank_names(spark):
    facts = spark.createDataFrame([("", "d1"), ("x", "d1"), (None, "d1")], "location string, d string")
    other = spark.createDataFrame([("", "d1", 1), ("x", "d1", 2)], "location string, d string, v int")
    got = rows(joins.add_second_fact(facts, other, ["location", "d"], "location"))
    assert got == [("", "d1", None), ("x", "d1", 2), (None, "d1", None)]


def test_semi_and_anti_joins_with_nulls(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(joins.having_match(left, right, "k")) == [("a",)]
    assert rows(joins.without_match(left, right, "k")) == [("b",), (None,)]


def test_time_join_reads_any_stamp_form(spark):
    facts = spark.createDataFrame([(1, "3/22/20 23:45"), (2, "2020-03-22T23:45:00"), (3, "junk")], "i int, last_update string")
    dim = spark.createDataFrame([("2020-03-22 23:45:00", 23)], "last_update string, hour int")
    got = rows(joins.add_time_parts(facts, dim), "i", "hour")
    assert got == [(1, 23), (2, 23), (3, None)]


def test_set_differences(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "x string")
    right = spark.createDataFrame([("b",), ("c",), (None,)], "y string")
    assert rows(groups.only_in_one(left, right, "left", "right")) == [("a", "left"), ("c", "right")]
    empty = spark.createDataFrame([], "y string")
    assert rows(groups.only_in_one(left, empty, "l", "r"), "value") == [("a",), ("b",), (None,)]


def test_next_day_and_duplicates(spark):
    days = spark.createDataFrame([("2020-02-28",), ("2020-02-29",)], "d string").select(F.to_date("d").alias("d"))
    assert len(rows(groups.with_next_day(days, "d"))) == 3
    assert rows(groups.with_next_day(days.limit(0), "d")) == []
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 1), (None, 1)], "k string, n int")
    assert rows(groups.duplicate_keys(df, ["k"])) == [("a", 2), (None, 2)]
    assert rows(groups.options(df, "k")) == [("a",), ("b",)]


CLASSES = [
    ("people", 1, 10, None), ("people", 2, 20, 15), ("people", 3, None, None),
    ("lapsed", 1, 10, 5), ("lapsed", 2, 20, None),
    ("total", 1, 10, None),
    ("none", 1, None, 7),
    ("tie", 1, 10, None), ("tie", 1, 10, 3),
]


def test_area_classes(spark):
    df = spark.createDataFrame(CLASSES, "c string, d int, total int, people int")
    expected = [("lapsed", "total_only"), ("people", "people"), ("tie", "people"), ("total", "total_only")]
    assert rows(metrics.area_classes(df, "c", "d", "total", "people")) == expected
    label = metrics.class_by_latest(F.col("total"), F.col("people"), ["c"], "d")
    assert rows(df.select("c", label.alias("k")).distinct().where("k is not null")) == expected
    any_rule = [("lapsed", "people"), ("none", "people"), ("people", "people"), ("tie", "people"), ("total", "total_only")]
    assert rows(metrics.area_classes_any(df, "c", "total", "people")) == any_rule
    label = metrics.class_by_any(F.col("total"), F.col("people"), ["c"])
    assert rows(df.select("c", label.alias("k")).distinct()) == any_rule


def test_adjusted_counts(spark):
    df = spark.createDataFrame(
        [("people", 9, 10, 4), ("people", 9, 10, None), ("people", 9, None, 4), ("total_only", 9, 1, 1), (None, 9, 9, 9)],
        "c string, t int, p int, f int",
    )
    adjusted = metrics.adjusted_by_class(F.col("c"), F.col("t"), F.col("p"), F.col("f"))
    usable = metrics.usable_for_class(F.col("c"), F.col("t"), F.col("p"))
    got = [tuple(row) for row in df.select(adjusted, usable).collect()]
    assert got == [(7.0, True), (5.0, True), (2.0, False), (4.5, True), (None, False)]
    assert [row[0] for row in df.select(metrics.adjusted_people(F.col("p"), F.col("f"))).collect()][:3] == [7.0, None, None]
