"""One small local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from stratica.session import session

    found = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    found.sparkContext.setLogLevel("ERROR")
    return found


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
