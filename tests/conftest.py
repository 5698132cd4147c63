import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablejobs.session import build_session, clear_scratch, scratch_namespace  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", app="tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture
def ns(spark):
    with scratch_namespace(spark, "test") as namespace:
        yield namespace


def rows(df):
    """Rows as plain tuples in a stable order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
