"""Queries on tables that end inside a frame, against their SQL twins."""

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from phasemill.catalog import ORACLES, QUERIES  # noqa: E402
from scripts.check_queries import compare  # noqa: E402


def equals_sql(spark, folder, name, n):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < {n}) TO '{folder}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    message, _, ok = compare(spark, con, QUERIES, ORACLES, name, str(folder))
    assert ok, message


@pytest.mark.parametrize("px", [4, 6, 15])  # of the second recording: one image row, less than eight, whole
def test_a_plane_is_fitted_to_few_pixels(spark, tmp_path, px):
    equals_sql(spark, tmp_path, "phase_plane_fit", 4 * (15 + px))


@pytest.mark.parametrize("px", [1, 34, 60])  # of the second recording, one of those with a NaN
def test_a_pixel_of_every_odd_frame_is_nan(spark, tmp_path, px):
    equals_sql(spark, tmp_path, "sigma_area", 60 + px)
