"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

``python tests/oracle.py 0.01 [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def compare(spark, sf_dir: str, name: str, query, sql: str | None) -> str:
    """Empty text if both sides agree, else what differs."""
    frame = query(spark, sf_dir)
    rows = frame.collect()
    if sql is None:
        return "" if rows else "no rows"
    result = connect(sf_dir).execute(sql)
    columns = [item[0] for item in result.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    order = sorted(columns)
    picks = [columns.index(column) for column in order]
    ours = Counter(tuple(canonical(row[column]) for column in order) for row in rows)
    theirs = Counter(tuple(canonical(row[pick]) for pick in picks) for row in result.fetchall())
    if ours == theirs:
        return "" if rows else "no rows"
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; "
        f"only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
    )


if __name__ == "__main__":
    from epimill.plans.reports import ORACLES, QUERIES
    from epimill.session import get_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    session = get_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        started = time.time()
        try:
            difference = compare(session, f"/root/testdata/sf{scale}", name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            difference = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(difference)
        print(f"{'ok  ' if not difference else 'FAIL'} {time.time() - started:6.2f}s {name} {difference}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    sys.exit(bool(failed))
