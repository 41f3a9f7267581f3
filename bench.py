"""Time the headline queries and print one JSON line.

Every query is run in full into Spark's no-op sink, after a short warm-up on the
smallest tables. The pass that loads the
analogue tables is timed as ``warehouse_load``, so its cost is not hidden in the
query that happens to come first.
"""

from __future__ import annotations

import json
import os
import time

from epimill.plans import analogue
from epimill.plans.reports import QUERIES
from epimill.session import get_session

HEADLINES = [
    "area_activity", "country_daily_sum", "country_daily_two_sums", "filtered_sum_ordered",
    "case_lookup_vac_left", "lookup_full_outer", "rows_without_match", "repeated_keys", "last_per_pair",
    "symmetric_diff", "daily_delta", "rolling7_min1", "rolling7_min7", "ewm_means", "outlier_drop",
    "outlier_free_trend", "death_case_ratio", "latest_snapshot", "adjusted_vaccinated", "country_class",
    "chart_latest", "chart_series", "parse_mixed_timestamps", "time_dimension", "case_time_join",
    "half_even_counts", "dedupe_keep_first", "point_corrections", "upsert_update", "upsert_ignore",
    "delete_reload", "ledger_upsert", "files_to_process", "ledger_reconcile", "lookup_gaps",
    "vaccination_gaps", "ingest_cases", "ingest_vaccinations", "reload_country", "stream_ingest", "csv_round_trip",
]


def warm_up(spark, sf_dir: str) -> None:
    """Load classes and compile hot code on the smallest tables, if they are there."""
    smallest = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest) and os.path.realpath(smallest) != os.path.realpath(sf_dir):
        for name in ("latest_snapshot", "upsert_update", "ingest_cases"):
            QUERIES[name](spark, smallest).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_session(
        "epimill-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm_up(spark, sf_dir)
    seconds: dict[str, float] = {}
    started = time.perf_counter()
    analogue.tables(spark, sf_dir)
    seconds["warehouse_load"] = round(time.perf_counter() - started, 3)
    for name in HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
