"""Every registered query with an SQL twin, on the smallest tables."""

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from phasemill.catalog import ORACLES, QUERIES  # noqa: E402
from scripts.check_queries import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(str(SF))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    message, _, ok = compare(spark, con, QUERIES, ORACLES, name, str(SF))
    assert ok, message
