"""A third of all rows under one key: joins are split, groups reduced before the shuffle."""

import datetime as dt
from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from epimill.operators import groups, joins, series, shape
from epimill.plans import analogue
from epimill.sinks.merge import upsert

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
N = 30000


@pytest.fixture
def small_partitions(spark):
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def skewed(spark):
    """Rows of which a third carry the key 'hot'."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")))
    return spark.range(N).repartition(16).select(F.col("id"), key.alias("k"))


def lookup(spark):
    names = spark.range(1200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    return names.unionByName(spark.sql("SELECT 'hot' AS k")).withColumn("v", F.length("k"))


def final_plan(df):
    rows = df.collect()
    return rows, plan_of(df)


def test_left_join_splits_the_hot_key(small_partitions):
    rows, plan = final_plan(joins.add_lookup(skewed(small_partitions), lookup(small_partitions), "k"))
    assert len(rows) == N
    assert "skew=true" in plan


def test_lookup_merge_splits_the_hot_key(small_partitions):
    rows, plan = final_plan(joins.merge_lookups(skewed(small_partitions), lookup(small_partitions), "k"))
    held = len({row["k"] for row in skewed(small_partitions).select("k").distinct().collect()})
    assert len(rows) == N + 1201 - held
    assert "skew=true" in plan


def test_anti_join_splits_the_hot_key(small_partitions):
    others = lookup(small_partitions).where("k <> 'hot'")
    rows, plan = final_plan(joins.without_match(skewed(small_partitions), others, "k"))
    assert len(rows) == N // 3
    assert "skew=true" in plan


def test_hot_key_on_the_right_of_a_semi_join_is_reduced_first(small_partitions):
    rows, plan = final_plan(joins.having_match(lookup(small_partitions), skewed(small_partitions), "k"))
    assert ("hot",) in [(row["k"],) for row in rows]
    assert plan.count("HashAggregate") >= 2


def test_load_of_a_hot_customer_is_split_and_whole(small_partitions, tmp_path):
    orders = small_partitions.range(N).repartition(16).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("o_custkey"),
        F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(cast(id % 9 as int))").alias("o_orderdate"),
        F.lit("F").alias("o_orderstatus"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    customers = small_partitions.range(500).repartition(4).select(
        F.col("id").alias("c_custkey"), (F.col("id") % 5).alias("c_nationkey"), F.lit("s").alias("c_mktsegment")
    )
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    rows, plan = final_plan(analogue.daily_activity(small_partitions, str(tmp_path)))
    assert "skew=true" in plan
    expected = Counter()
    for i in range(N):
        expected[(7 if i % 3 == 0 else i % 500) % 5, dt.date(2020, 1, 1 + i % 9)] += 1
    assert {(row["c_nationkey"], row["day"]): row["n_orders"] for row in rows} == expected


def test_groups_send_one_row_per_split_and_key(small_partitions):
    frame = skewed(small_partitions).withColumn("one", F.lit(1))
    summed = {row["k"]: row["n"] for row in groups.sum_by(frame, ["k"], {"n": "one"}).collect()}
    assert summed["hot"] == N // 3
    first = shape.first_per_key(frame, ["k"], ["id"])
    assert {row["k"]: row["id"] for row in first.collect()}["hot"] == 0
    last = series.last_row(frame, ["k"], "id")
    assert {row["k"]: row["id"] for row in last.collect()}["hot"] == N - 3
    for df in (first, last):
        plan = plan_of(df.select("k"))
        assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_upsert_of_repeated_batches_is_whole(small_partitions):
    rows = small_partitions.range(N).select("id", F.lit("old").alias("v"))
    batch = small_partitions.range(N // 2, 2 * N).select("id", F.lit("new").alias("v"))
    merged = upsert(rows, batch, ["id"], ["v"]).groupBy("v").count()
    assert {row["v"]: row["count"] for row in merged.collect()} == {"old": N // 2, "new": 2 * N - N // 2}
