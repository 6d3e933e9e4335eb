"""Flooding and reconstruction over bands of image rows, against plain relaxation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from phasemill.operators import refine, tileflood

BASE = "rec_id string, height int, width int, y int, x int, _e double, level double, hops int"


def relax(rows, conn, count_hops):
    """Bellman-Ford over the pixels of one key."""
    e = {(r[3], r[4]): r[5] for r in rows}
    cost = {(r[3], r[4]): (r[6], r[7]) for r in rows if r[6] is not None}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (conn == 8 or not (a and b))]
    going = True
    while going:
        going = False
        for (y, x), h in e.items():
            for dy, dx in steps:
                o = cost.get((y + dy, x + dx))
                if o is None or h is None:
                    continue
                new = (max(o[0], h), 0 if h > o[0] or not count_hops else o[1] + 1)
                if (y, x) not in cost or new < cost[y, x]:
                    cost[y, x] = new
                    going = True
    return cost


def frame(rec, h, w, seed, sources=3):
    r = random.Random(seed)
    rows = []
    for y in range(h):
        for x in range(w):
            if r.random() < 0.1:
                continue  # outside the mask
            e = None if r.random() < 0.1 else float(r.randrange(5))
            rows.append([rec, h, w, y, x, e, None, None])
    for row in r.sample([row for row in rows if row[5] is not None], sources):
        row[6:] = [row[5], 0]
    return rows


@pytest.mark.parametrize("tile", [1, 3, 64])
@pytest.mark.parametrize("conn,count_hops", [(8, True), (4, False)])
def test_bands_equal_plain_relaxation(spark, monkeypatch, tile, conn, count_hops):
    monkeypatch.setattr(tileflood, "TILE_ROWS", tile)
    keys = {"a": frame("a", 11, 7, 1), "b": frame("b", 3, 9, 2, 1), "none": frame("none", 4, 4, 3, 0)}
    df = spark.createDataFrame([tuple(row) for rows in keys.values() for row in rows], BASE)
    got = {(r.rec_id, r.y, r.x): (r.level, r.hops) for r in tileflood.spread(df, conn, ["rec_id"], count_hops).collect()}
    assert len(got) == df.count()
    for rec, rows in keys.items():
        want = relax(rows, conn, count_hops)
        assert {(y, x): c for (k, y, x), c in got.items() if k == rec and c[0] is not None} == want


def serpentine(rows=43, width=48):
    """A corridor of some 1,000 pixels that turns at the end of every other image row."""
    path = []
    for i, y in enumerate(range(0, rows, 2)):
        path += [(y, x) for x in (range(width) if i % 2 == 0 else reversed(range(width)))]
        if y + 2 < rows:
            path.append((y + 1, width - 1 if i % 2 == 0 else 0))
    return path


def test_long_corridor_takes_one_round(spark, monkeypatch):
    path = serpentine()
    rows = [("c", 43, 48, y, x, 1.0, 1.0 if n == 0 else None, 0 if n == 0 else None) for n, (y, x) in enumerate(path)]
    written = []
    monkeypatch.setattr(tileflood, "cut", lambda df, plain=tileflood.cut: written.append(1) or plain(df))
    got = {(r.y, r.x): r.hops for r in tileflood.spread(spark.createDataFrame(rows, BASE), 4).collect()}
    assert got == {p: n for n, p in enumerate(path)} and len(path) > 1000
    assert len(written) == 2  # the flooded frame and its empty list of offers


def test_reconstruction_with_nan_and_null(spark, monkeypatch):
    monkeypatch.setattr(tileflood, "TILE_ROWS", 1)
    nan = float("nan")
    rows = [("r", 5, 1, y, 0, k, m) for y, (k, m) in enumerate([(1.0, 0.0), (9.0, 2.0), (9.0, None), (9.0, nan), (9.0, 0.0)])]
    df = spark.createDataFrame(rows, "rec_id string, height int, width int, y int, x int, k double, m double")
    got = [r.level for r in refine.reconstruct_erosion(df, "k", "m").orderBy("y").collect()]
    assert got[:3] == [1.0, 2.0, 2.0] and math.isnan(got[3]) and got[4] == 9.0


def test_reconstruction_across_bands(spark, monkeypatch):
    r = random.Random(4)
    rows = [("r", 9, 6, y, x, 9.0 if r.random() < 0.9 else 0.0, float(r.randrange(6))) for y in range(9) for x in range(6)]
    df = spark.createDataFrame(rows, "rec_id string, height int, width int, y int, x int, k double, m double")
    whole = {(q.y, q.x): q.level for q in refine.reconstruct_erosion(df, "k", "m").collect()}
    monkeypatch.setattr(tileflood, "TILE_ROWS", 2)
    assert {(q.y, q.x): q.level for q in refine.reconstruct_erosion(df, "k", "m").collect()} == whole
    start = [(rec, h, w, y, x, m, max(k, m), 0) for rec, h, w, y, x, k, m in rows]
    assert whole == {p: c[0] for p, c in relax(start, 8, False).items()}
