import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from epimill.session import get_session, scratch_path  # noqa: E402
from epimill.sinks.warehouse import Warehouse  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "epimill-tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.maxMetadataStringLength": "4000"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def warehouse(spark):
    house = Warehouse(spark, f"t_{uuid.uuid4().hex}", scratch_path(spark, "test-warehouse"))
    house.create_tables()
    return house


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in picked.collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
