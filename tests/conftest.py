import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracelake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, "6g", "tracelake-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column over one row."""
    def run(column, schema=None, row=None):
        frame = spark.createDataFrame([row], schema) if schema else spark.range(1)
        return frame.select(column.alias("v")).first()["v"]
    return run
