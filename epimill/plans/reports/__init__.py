"""Registered queries: each pairs a Spark query with the SQL that checks it."""

from epimill.plans.reports import charts, checks, cleaning, counts, files, loads, series, vaccination
from epimill.plans.reports.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "charts", "checks", "cleaning", "counts", "files", "loads", "series", "vaccination"]
