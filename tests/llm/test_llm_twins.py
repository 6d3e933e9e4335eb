"""Registered queries against their SQL twins on the smallest tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")

from phasemill.llm.queries import ORACLES, QUERIES  # noqa: E402
from scripts.check_queries import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(str(SF))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    message, _, ok = compare(spark, con, QUERIES, ORACLES, name, str(SF))
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_scored_query_returns_every_document_again_and_again(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    one = {tuple(r) for r in QUERIES[name](spark, str(SF)).collect()}
    assert len(one) == n
    assert one == {tuple(r) for r in QUERIES[name](spark, str(SF)).collect()}
    assert all(0 <= r[2 if name != "op5_language" else 3] <= 1 for r in one)


def test_tool_log_holds_every_case(spark):
    """The ordering decides: levels above 0 and cycles arise, as does every status and both verdicts on arguments."""
    rows = QUERIES["op3_tool_calls"](spark, "/root/testdata/sf0.01").collect()
    assert {r.status for r in rows} == {"linked", "unanswered", "misplaced", "cyclic", "repeated", "orphan", "nameless"}
    assert {0, 1, 2} <= {r.level for r in rows}
    assert {r.valid for r in rows} == {True, False, None}
