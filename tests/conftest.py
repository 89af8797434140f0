import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """The value of an expression over one row of columns."""

    def of(expression, schema=None, row=None):
        frame = spark.createDataFrame([row], schema) if schema else spark.range(1)
        return frame.select(expression.alias("v")).first()["v"]

    return of
