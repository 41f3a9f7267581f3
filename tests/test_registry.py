"""All registered queries against DuckDB, and the shape of their plans."""

import os
import re
import subprocess
import sys
from types import SimpleNamespace

import pytest
from conftest import plan_of
from oracle import compare

import __spark_entry__ as entry
from epimill.plans import analogue
from epimill.plans import reports as analogue_reports
from epimill.session import scratch_path, shuffle_partitions
from epimill.sinks.warehouse import Warehouse

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = analogue_reports.QUERIES, analogue_reports.ORACLES
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_outlast_a_missing_library():
    code = "import sys; sys.modules['tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    run = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and int(run.stdout) >= len(QUERIES)


@needs_data
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, SF_DIR, name, QUERIES[name], ORACLES[name]) == ""


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


LOADS = {name for name in QUERIES if name.startswith(("ingest_", "land", "reload", "rewrite", "stream"))}


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - LOADS))
def test_plan_shape(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "InArrow", "SinglePartition, REPARTITION"):
        assert operator not in plan


@needs_data
def test_scans_are_pruned_and_filters_pushed(spark):
    plan = plan_of(QUERIES["filter_predicates"](spark, SF_DIR))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "o_custkey" not in plan
    plan = plan_of(QUERIES["country_level_rows"](spark, SF_DIR))
    assert "Or(IsNull(province_state),EqualTo(province_state,))" in plan
    plan = plan_of(QUERIES["chart_series"](spark, SF_DIR))
    assert "In(country_region, [NATION_2,NATION_5,NATION_9])" in plan


@needs_data
def test_core_query_shuffles_country_rows_once(spark):
    plan = plan_of(QUERIES["latest_snapshot"](spark, SF_DIR))
    assert len(re.findall(r"Exchange hashpartitioning\(country_region#\d+, \d+\)", plan)) == 1
    # the lookup guard deals the lookup, not the country rows, by key and what spreads null keys
    assert plan.count("Exchange hashpartitioning(country_region") == 2
    assert "WindowGroupLimit" in plan


@needs_data
def test_stored_partitions_are_pruned(spark, warehouse):
    plan = plan_of(warehouse.stored("daily_case").where("date_case = date'2020-01-22'"))
    assert "PartitionFilters: [isnotnull(date_case" in plan


@needs_data
def test_results_do_not_depend_on_partitioning(spark):
    loaded = analogue.tables(spark, SF_DIR)
    from epimill.plans.dashboard import adjusted_series, combine, latest_status

    def snapshot(n):
        frames = [frame.repartition(n) for frame in (loaded.daily_case, loaded.vac, loaded.country_loc)]
        return sorted(map(repr, latest_status(adjusted_series(combine(*frames))).collect()))

    assert snapshot(1) == snapshot(7)


def test_shared_folder_is_read_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path != scratch_path(spark, "x")
    if configured:
        assert path.startswith(configured)


def pretend_cluster(**conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: conf.get(name, default)),
        sparkContext=SimpleNamespace(master="spark://cluster:7077", applicationId="app"),
        catalog=SimpleNamespace(databaseExists=lambda name: False),
    )


def test_partitions_grow_with_the_shuffle():
    assert shuffle_partitions(10**9) == 200
    assert 50_000 < shuffle_partitions(30e12) < 60_000


def test_a_cluster_needs_shared_folders():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(pretend_cluster(), "x")
    assert scratch_path(pretend_cluster(**{"spark.checkpoint.dir": "/shared/"}), "x").startswith("/shared/x-")
    with pytest.raises(RuntimeError, match="location"):
        Warehouse(pretend_cluster(**{"spark.sql.warehouse.dir": "file:/root/spark-warehouse"}))
