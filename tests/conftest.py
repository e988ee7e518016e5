import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from foreloom.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("foreloom-tests", cores="8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture
def short_groups(spark):
    """Limits so low that every group takes the route of long groups."""
    keys = {
        "spark.foreloom.groupRows": "25",
        "spark.foreloom.packRows": "20",
        "spark.foreloom.broadcastRows": "10",
    }
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)
