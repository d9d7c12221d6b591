import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from photocat.session import (  # noqa: E402
    BLOCK_ROWS,
    MAX_BROADCAST_ROWS,
    MAX_WINDOW_ROWS,
    RANGE_ROWS,
    build_session,
)


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(spark):
    """Forces the paths meant for groups and tables too large for one task."""
    values = {MAX_WINDOW_ROWS: 20, BLOCK_ROWS: 16, MAX_BROADCAST_ROWS: 0, RANGE_ROWS: 400}
    for (key, _), value in values.items():
        spark.conf.set(key, str(value))
    yield
    for key, _ in values:
        spark.conf.unset(key)
