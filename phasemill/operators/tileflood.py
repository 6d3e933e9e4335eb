"""Flooding and reconstruction by tiles.

A frame is cut into bands of image rows. Inside a band a pixel's final height is found at once, by a heap that takes
pixels in the order of their height; between bands only border rows are exchanged, and only bands that receive a
better offer run again. The number of rounds is the number of band borders that the longest path crosses, not
its length in pixels: a frame of up to TILE_ROWS rows takes one. A band is bounded by the sensor's width.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.operators.stencil import REC, SIZE
from phasemill.session import cut

TILE_ROWS = 64


def _relax(table: pa.Table, conn: int, count_hops: bool) -> pa.Table:
    """Lower the heights of one band's own pixels as far as its sources, or the offers of its neighbours, allow."""
    ys, xs, passes, level, hops, own = (table.column(c).to_pylist() for c in ("y", "x", "_e", "level", "hops", "_own"))
    at = {(y, x): i for i, (y, x) in enumerate(zip(ys, xs))}
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (conn == 8 or not (dy and dx))]
    offers = [i for i, mine in enumerate(own) if not mine]
    first = offers or [i for i, h in enumerate(level) if h is not None]
    moved = [bool(not offers and h is not None) for h in level]
    heap = [(level[i], hops[i], i) for i in first]
    heapq.heapify(heap)
    while heap:
        height, n, i = heapq.heappop(heap)
        if (height, n) != (level[i], hops[i]):
            continue  # a better one came first
        y, x = ys[i], xs[i]
        for dy, dx in steps:
            j = at.get((y + dy, x + dx))
            if j is None or not own[j] or passes[j] is None:
                continue
            rises = passes[j] > height
            new = (passes[j] if rises else height, 0 if rises or not count_hops else n + 1)
            if level[j] is None or new < (level[j], hops[j]):
                level[j], hops[j] = new
                moved[j] = True
                heapq.heappush(heap, (*new, j))
    put = table
    for name, values, kind in (("level", level, pa.float64()), ("hops", hops, pa.int32()), ("_moved", moved, pa.bool_())):
        put = put.set_column(put.schema.get_field_index(name), name, pa.array(values, kind))
    return put.filter(pa.array(own)) if offers else put


def spread(base: DataFrame, conn: int, keys: Sequence[str] = REC, count_hops: bool = True) -> DataFrame:
    """The lowest (level, hops) at which each pixel is reached from the sources of its key.

    `base`: keys, frame size, y, x, `_e` (the height a pixel has to be passed at; null: a wall), `level` and `hops`
    of sources (null elsewhere). A step to a neighbour rises to its `_e` with 0 hops, or stays at the level with one
    hop more (0 if hops do not count). Pixels that nothing reaches keep null.
    """
    keys = list(keys)
    group = [*keys, "_tile"]
    columns = [*keys, *SIZE, "y", "x", "_e", "level", "hops", "_tile", "_own", "_moved"]
    tiled = base.select(
        *keys, *SIZE, "y", "x", F.col("_e").cast("double").alias("_e"), F.col("level").cast("double").alias("level"), F.col("hops").cast("int").alias("hops"),
        F.floor(F.col("y") / TILE_ROWS).cast("int").alias("_tile"), F.lit(True).alias("_own"), F.lit(False).alias("_moved"),
    )

    def run(df: DataFrame) -> DataFrame:
        return df.select(*columns).groupBy(*group).applyInArrow(lambda table: _relax(table, conn, count_hops), tiled.schema)

    cur, done = cut(run(tiled)), None
    while True:
        place = F.col("y") % TILE_ROWS
        sides = F.array_compact(F.array(F.when(place == 0, F.col("_tile") - 1), F.when(place == TILE_ROWS - 1, F.col("_tile") + 1)))
        border = cur.filter("_moved AND level IS NOT NULL").withColumn("_to", F.explode(sides))
        tiles = cur.select(*group).distinct()
        offers = border.withColumn("_tile", F.col("_to")).withColumn("_own", F.lit(False)).select(*columns).join(tiles, group, "left_semi")
        offers = cut(offers)
        still = cur.withColumn("_moved", F.lit(False))
        if offers.isEmpty():
            out = still if done is None else done.unionByName(still)
            return out.select(*keys, *SIZE, "y", "x", "level", "hops")
        active = cut(offers.select(*group).distinct())
        alive = active.select(*keys).distinct()
        settled = still.join(alive, keys, "left_anti")
        done = settled if done is None else done.unionByName(settled)
        going = still.join(alive, keys, "left_semi")
        again = run(going.join(active, group, "left_semi").select(*columns).unionByName(offers))
        cur = cut(going.join(active, group, "left_anti").select(*columns).unionByName(again))
