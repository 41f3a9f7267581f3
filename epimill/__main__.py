"""Command line: ``python -m epimill update|check|latest --root FOLDER``."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame

from epimill.plans.dashboard import adjusted_series, combine, latest_status
from epimill.plans.quality import check_all
from epimill.plans.update import Landing, daily_update
from epimill.session import get_session
from epimill.sinks.csv_files import write_csv
from epimill.sinks.warehouse import Warehouse


def main() -> None:
    parser = argparse.ArgumentParser(prog="epimill")
    parser.add_argument("command", choices=["update", "check", "latest"])
    parser.add_argument("--root", required=True, help="landing folder")
    parser.add_argument("--database", default="epimill")
    parser.add_argument("--location", help="folder of the database, unless the catalog knows it")
    parser.add_argument("--out", help="folder for the results of check and latest; below the root by default")
    options = parser.parse_args()

    warehouse = Warehouse(get_session(), options.database, options.location)
    warehouse.create_tables()
    landing = Landing(options.root)
    if options.command == "update":
        print(daily_update(warehouse, landing))
    elif options.command == "check":
        write_result(check_all(warehouse, landing), options)
    else:
        tables = [warehouse.read(name) for name in ("daily_case", "vac", "country_loc")]
        write_result(latest_status(adjusted_series(combine(*tables))), options)


def write_result(rows: DataFrame, options: argparse.Namespace) -> None:
    """Write all rows as CSV to a new folder; tell how many there are and show the first."""
    folder = options.out or f"{options.root.rstrip('/')}/results"
    path = f"{folder}/{options.command}-{uuid.uuid4().hex}"
    write_csv(rows, path)
    written = rows.sparkSession.read.option("header", "true").csv(path)
    print(f"{written.count()} rows in {path}; the first of them:")
    written.show(20, truncate=False)


if __name__ == "__main__":
    main()
