import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from attestlake.session import build_session

    session = build_session(
        "attestlake-tests",
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__log__level="ERROR",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    yield session
    session.stop()


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


@pytest.fixture(scope="session")
def tables(spark):
    from attestlake.plans.registry import Tables

    return Tables(spark, SF)
