from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from alertlens.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session("local[4]", app_name="alertlens-tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def clean_mart_001(spark):
    from alertlens.plans.catalog import clean_mart

    return clean_mart(spark, SF001).cache()


@pytest.fixture(scope="session")
def dirty_mart_001(spark):
    from alertlens.plans.catalog import dirty_mart

    return dirty_mart(spark, SF001).cache()


@pytest.fixture(scope="session")
def clean_mart_01(spark):
    from alertlens.plans.catalog import clean_mart

    return clean_mart(spark, SF01).cache()


@pytest.fixture(scope="session")
def dirty_mart_01(spark):
    from alertlens.plans.catalog import dirty_mart

    return dirty_mart(spark, SF01).cache()


def mart_frame(spark, rows):
    """Mart-shaped frame from (year, month, day, NAME, Count) tuples."""
    from alertlens.operators.mart import MART_SCHEMA

    data = [(y, m, dt.date(y, m, d), name, c) for (y, m, d, name, c) in rows]
    return spark.createDataFrame(data, MART_SCHEMA)
