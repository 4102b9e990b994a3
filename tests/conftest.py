import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fleetlog.session import SPAN_LINES, SPAN_MILLIS, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "fleetlog-tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def tiny_segments(spark):
    """Many segments per key, so that hand-over between segments is exercised."""
    spark.conf.set(SPAN_LINES, "7")
    spark.conf.set(SPAN_MILLIS, "3600000")
    yield
    spark.conf.unset(SPAN_LINES)
    spark.conf.unset(SPAN_MILLIS)
