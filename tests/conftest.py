import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import spark_session  # noqa: E402

from flowwatch.operators import order  # noqa: E402
from flowwatch.session import ship_package  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = spark_session(4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def tiny_tasks(monkeypatch):
    """Make every row set "too large for one task", to drive the split paths."""
    monkeypatch.setattr(order, "TASK_ROWS", 97)
