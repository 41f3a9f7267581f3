"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epimill.plans.analogue import ORACLE_TABLES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def report(sql: str | None = None, steps: str = "", tables: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function name.

    ``sql`` is the check; ``tables`` puts the warehouse tables before it and
    ``steps`` further common table expressions.
    """

    def register(query: Query) -> Query:
        name = query.__name__
        QUERIES[name] = query
        if sql is not None:
            parts = [part.strip() for part in (ORACLE_TABLES if tables else "", steps) if part.strip()]
            ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + sql.strip()
        return query

    return register
