import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from haulcast.session import local_session

    session = local_session(8, "8g", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Build a small frame from tuples and a schema string."""
    return lambda data, schema: spark.createDataFrame(data, schema)
