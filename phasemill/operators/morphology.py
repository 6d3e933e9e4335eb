"""Binary morphology and set operations on sparse masks (rows of keys, height, width, y, x)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasemill.operators import components
from phasemill.operators.stencil import REC, SIZE, Span, cross, disk
from phasemill.session import cut


def _px(keys):
    return [*keys, *SIZE, "y", "x"]


def spans_of(shape: str, n: int) -> list[Span]:
    if shape == "disk":
        return disk(n)
    if shape == "cross":
        return cross(n)
    raise ValueError(f"unknown shape {shape!r}")


# ---- set operations ------------------------------------------------------------------------------


def mask_union(a: DataFrame, b: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    return a.select(*_px(keys)).union(b.select(*_px(keys))).distinct()


def mask_minus(a: DataFrame, b: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    k = [*keys, "y", "x"]
    return a.join(b.select(*k), k, "left_anti")


def mask_and(a: DataFrame, b: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    k = [*keys, "y", "x"]
    return a.join(b.select(*k), k, "left_semi")


# ---- dilation, erosion, opening, closing ------------------------------------------------------------


def runs(mask: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """The mask as runs of an image row: (keys, frame size, y, lo, hi). Windows are bounded by the sensor's width."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    island = mask.select(*_px(keys)).withColumn("_i", F.col("x") - F.dense_rank().over(row))
    return island.groupBy(*keys, *SIZE, "y", "_i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).drop("_i")


def _covered(intervals: DataFrame, need, keys: Sequence[str]) -> DataFrame:
    """Pixels that at least `need` of the intervals (y, lo, hi) cover; `need` may depend on y and the frame size."""
    k = [*keys, *SIZE, "y"]
    edges = F.array(F.struct(F.col("lo").alias("x"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("x"), F.lit(-1).alias("d")))
    at = intervals.repartition(*keys, "y").select(*k, F.inline(edges)).groupBy(*k, "x").agg(F.sum("d").alias("_d"))
    row = Window.partitionBy(*keys, "y").orderBy("x")
    deep = at.withColumns({"_n": F.sum("_d").over(row), "_next": F.lead("x").over(row)})
    held = deep.filter((F.col("_n") >= need) & (F.col("_n") > 0))
    return held.select(*k, F.explode(F.sequence(F.col("x").cast("int"), (F.col("_next") - 1).cast("int"))).alias("x"))


def _shifted(mask: DataFrame, spans: Sequence[Span], keys: Sequence[str], lo, hi) -> DataFrame:
    """One interval per run and span, in the row that the span reaches, clipped to the frame."""
    offsets = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("a"), F.lit(c).alias("b")) for a, b, c in spans])
    moved = runs(mask, keys).select(*keys, *SIZE, "y", "lo", "hi", F.explode(offsets).alias("_s"))
    moved = moved.select(
        *keys, *SIZE, (F.col("y") + F.col("_s.dy")).cast("int").alias("y"), F.greatest(lo, F.lit(0)).alias("lo"),
        F.least(hi, F.col("width") - 1).alias("hi"),
    )
    return moved.filter("y >= 0 AND y < height AND lo <= hi")


def dilate(mask: DataFrame, shape: str, n: int, keys: Sequence[str] = REC) -> DataFrame:
    """Runs grow by the spans of the shape: 2n+1 intervals a run, whatever the number of its pixels."""
    if n <= 0:
        return mask.select(*_px(keys))
    grown = _shifted(mask, spans_of(shape, n), keys, F.col("lo") + F.col("_s.a"), F.col("hi") + F.col("_s.b"))
    return _covered(grown, F.lit(1), keys)


def erode(mask: DataFrame, shape: str, n: int, keys: Sequence[str] = REC) -> DataFrame:
    """A disk treats the outside of the frame as set, a cross as unset.

    A run shrinks by the span of each row that it has to cover; a pixel stays if it is covered once for every
    row of the shape. For a disk, rows outside the frame need no cover and runs at its edge go on outside.
    """
    if n <= 0:
        return mask.select(*_px(keys))
    spans = [(-dy, lo, hi) for dy, lo, hi in spans_of(shape, n)]
    lo, hi = F.col("lo") - F.col("_s.a"), F.col("hi") - F.col("_s.b")
    if shape == "disk":
        lo, hi = F.when(F.col("lo") == 0, 0).otherwise(lo), F.when(F.col("hi") == F.col("width") - 1, F.col("hi")).otherwise(hi)
        need = F.least(F.col("y") + n, F.col("height") - 1) - F.greatest(F.col("y") - n, F.lit(0)) + 1
    else:
        need = F.lit(len(spans))
    return _covered(_shifted(mask, spans, keys, lo, hi), need, keys)


def opening(mask: DataFrame, shape: str, n: int, keys: Sequence[str] = REC) -> DataFrame:
    return dilate(erode(mask, shape, n, keys), shape, n, keys)


def closing(mask: DataFrame, shape: str, n: int, keys: Sequence[str] = REC) -> DataFrame:
    """A disk closes inside a frame enlarged by n; a cross composes plainly."""
    if n <= 0:
        return mask.select(*_px(keys))
    if shape == "cross":
        return erode(dilate(mask, shape, n, keys), shape, n, keys)
    grown = mask.select(
        *keys, (F.col("height") + 2 * n).alias("height"), (F.col("width") + 2 * n).alias("width"),
        (F.col("y") + n).alias("y"), (F.col("x") + n).alias("x"),
    )
    closed = erode(dilate(grown, shape, n, keys), shape, n, keys)
    back = closed.select(
        *keys, (F.col("height") - 2 * n).alias("height"), (F.col("width") - 2 * n).alias("width"),
        (F.col("y") - n).alias("y"), (F.col("x") - n).alias("x"),
    )
    return back.filter("y >= 0 AND y < height AND x >= 0 AND x < width")


def gaps(mask: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """What lies between two runs of an image row: (keys, frame size, y, lo, hi, _closed).

    What lies before the first run or behind the last one reaches the frame edge along its row. A gap is closed if both rows
    next to it have pixels on either side of it; otherwise a step up or down leads to such a place, or out of the frame.
    """
    row = Window.partitionBy(*keys, "y").orderBy("lo")  # bounded by the sensor's width
    whole = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = runs(mask, keys).withColumns(
        {"_next": F.lead("lo").over(row), "_x0": F.min("lo").over(whole), "_x1": F.max("hi").over(whole)}
    )
    k = [*keys, *SIZE, "y"]
    between = r.filter("_next IS NOT NULL").select(*k, (F.col("hi") + 1).alias("lo"), (F.col("_next") - 1).alias("hi"))
    beside = r.filter("lo = _x0").select(*keys, *SIZE, F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("y"), "_x0", "_x1")
    met = between.join(beside, k, "left").groupBy(*k, "lo", "hi")
    return met.agg((F.count_if((F.col("lo") >= F.col("_x0")) & (F.col("hi") <= F.col("_x1"))) == 2).alias("_closed"))


def fill_holes(mask: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """Background components that do not reach the frame edge become set.

    A hole consists of closed gaps of image rows, so only their pixels are spread and labelled, whatever the area that
    the mask is scattered over.
    """
    keys = list(keys)
    mask = mask.select(*_px(keys))
    between = cut(gaps(mask, keys))
    closed = between.filter("_closed")
    if closed.isEmpty():
        return mask
    across = F.explode(F.sequence("lo", "hi")).alias("x")
    roots = cut(components.component_roots(closed.select(*keys, *SIZE, "y", across), 4, keys))
    beside = F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("y")
    out = between.filter("NOT _closed").select(*keys, beside, "lo", "hi").select(*keys, "y", across)
    air = roots.join(out, [*keys, "y", "x"], "left_semi").select(*keys, "root").distinct()
    holes = roots.join(air, [*keys, "root"], "left_anti").select(*_px(keys))
    return mask.union(holes)


# ---- thinning ------------------------------------------------------------------------------------


def _neighbour_ring(code: int) -> list[int]:
    """The eight neighbours of a code in circular order N, NE, E, SE, S, SW, W, NW."""
    # Bit weights NW 1, N 2, NE 4, E 8, SE 16, S 32, SW 64, W 128
    return [(code >> b) & 1 for b in (1, 2, 3, 4, 5, 6, 7, 0)]


def thinning_codes() -> tuple[list[int], list[int]]:
    """Neighbour codes whose centre is removed in the first and in the second sub-pass.

    The rule (Zhang and Suen 1984): 2..6 set neighbours, exactly one 0→1 step around the ring, and
    N·E·S = E·S·W = 0 in the first sub-pass, N·E·W = N·S·W = 0 in the second.
    """
    first, second = [], []
    for code in range(256):
        n, ne, e, se, s, sw, w, nw = ring = _neighbour_ring(code)
        steps = sum(1 for a, b in zip(ring, ring[1:] + ring[:1]) if a == 0 and b == 1)
        if not (2 <= sum(ring) <= 6 and steps == 1):
            continue
        if n * e * s == 0 and e * s * w == 0:
            first.append(code)
        if n * e * w == 0 and n * s * w == 0:
            second.append(code)
    return first, second


# Fixed values: (dy, dx, weight) of the neighbour as seen from the centre pixel
RING_WEIGHTS = [
    (-1, -1, 1), (-1, 0, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 16), (1, 0, 32), (1, -1, 64), (0, -1, 128),
]


THIN_ROWS, THIN_HALO = 64, 32


def _neighbour_codes(grid: np.ndarray) -> np.ndarray:
    """The neighbour code of every cell of a grid; beyond its edge nothing is set."""
    h, w = grid.shape
    wide = np.pad(grid, 1)
    code = np.zeros((h, w), np.uint8)
    for dy, dx, weight in RING_WEIGHTS:
        code |= wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] * np.uint8(weight)
    return code


def _thin_band(table: pa.Table, passes: Sequence[np.ndarray], steps: int) -> pa.Table:
    """`steps` sub-passes over one band and its halo, of which a sub-pass makes one image row on each side unsure.

    Gives the band's own pixels and, at y = -1, one row whose x says whether the last full iteration changed any.
    """
    band = table.column("_band")[0].as_py()
    top = band * THIN_ROWS
    y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
    y0, x0 = int(y.min()), int(x.min())
    grid = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.uint8)
    grid[y - y0, x - x0] = 1
    own = slice(max(top - y0, 0), max(top + THIN_ROWS - y0, 0))
    moved = False
    for _ in range(steps // 2):
        before = grid
        for gone in passes:
            grid = grid & ~(grid & gone[_neighbour_codes(grid)])
        moved = bool((before[own] != grid[own]).any())
        if not (before != grid).any():
            break
    ys, xs = np.nonzero(grid[own])
    ys = np.append(ys + y0 + own.start, -1).astype(np.int32)
    xs = np.append(xs + x0, int(moved)).astype(np.int32)
    cells = table.slice(0, 1).take(pa.array(np.zeros(len(ys), np.int64)))
    for name, values in (("y", ys), ("x", xs)):
        cells = cells.set_column(cells.schema.get_field_index(name), name, pa.array(values))
    return cells


def skeletonize(
    mask: DataFrame, keys: Sequence[str] = REC, codes: tuple[Sequence[int], Sequence[int]] | None = None,
) -> DataFrame:
    """Two-sub-pass thinning until nothing changes.

    `codes` gives the neighbour codes removed in each sub-pass; the default is the Zhang-Suen rule. Bands of
    image rows are thinned with a halo that is as deep as the sub-passes of a round, so that a round of 32 sub-passes
    costs one exchange and is exact; masks up to about 30 pixels thick take one or two rounds. Keys that stand still
    leave the loop. An empty mask has an empty skeleton.
    """
    keys = list(keys)
    passes = []
    for removable in codes or thinning_codes():
        gone = np.zeros(256, np.uint8)
        gone[list(removable)] = 1
        passes.append(gone)
    columns = [*_px(keys), "_band"]
    px = mask.select(*keys, *SIZE, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    cur, done = px, None
    while True:
        band, place = F.floor(F.col("y") / THIN_ROWS).cast("int"), F.pmod(F.col("y"), F.lit(THIN_ROWS))
        reach = F.array(
            band, F.when(place < THIN_HALO, band - 1), F.when(place >= THIN_ROWS - THIN_HALO, band + 1)
        )
        spread = cur.withColumn("_band", F.explode(F.array_compact(reach))).select(*columns)
        thin = spread.groupBy(*keys, "_band").applyInArrow(lambda t: _thin_band(t, passes, THIN_HALO), spread.schema)
        thin = cut(thin)
        moving = cut(thin.filter("y = -1 AND x = 1").select(*keys).distinct())
        now = thin.filter("y >= 0").select(*_px(keys))
        if moving.isEmpty():
            return now if done is None else done.unionByName(now)
        settled = now.join(moving, keys, "left_anti")
        done = settled if done is None else done.unionByName(settled)
        cur = now.join(moving, keys, "left_semi")


# ---- distance ------------------------------------------------------------------------------------


def _lower_envelope(g: list[int | None]) -> list[float]:
    """min over c of g[c]² + (x − c)² for every x, by the lower envelope of these parabolas: linear in the row."""
    at: list[int] = []  # columns of the envelope's parabolas, and where each begins to be the lowest
    begins: list[float] = []
    for c, h in enumerate(g):
        if h is None:
            continue
        start = float("-inf")
        while at:
            last = at[-1]
            start = ((h * h + c * c) - (g[last] * g[last] + last * last)) / (2.0 * (c - last))
            if start > begins[-1]:
                break
            at.pop()
            begins.pop()
            start = float("-inf")
        at.append(c)
        begins.append(start)
    if not at:
        return [float("inf")] * len(g)
    out, i = [], 0
    for x in range(len(g)):
        while i + 1 < len(at) and begins[i + 1] <= x:
            i += 1
        out.append(float(g[at[i]] * g[at[i]] + (x - at[i]) * (x - at[i])))
    return out


def distance_to(mask: DataFrame, dims: DataFrame, keys: Sequence[str] = REC, name: str = "dist") -> DataFrame:
    """Exact Euclidean distance of every pixel to the nearest set pixel; inf for an empty mask.

    Separable: nearest set pixel along the column by two windows, then one pass over each image row.
    """
    keys = list(keys)
    marks = mask.select(*keys, "y", "x", F.lit(True).alias("_set"))
    px = components.frame_pixels(dims, keys).join(marks, [*keys, "y", "x"], "left")
    w = Window.partitionBy(*keys, "x").orderBy("y")
    at = F.when(F.col("_set"), F.col("y"))
    up = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    col_d = px.select(*_px(keys), F.least(F.col("y") - up, down - F.col("y")).alias("_g"))
    cells = F.array_sort(F.collect_list(F.struct("x", "_g")))  # one image row
    rows = col_d.groupBy(*keys, *SIZE, "y").agg(F.transform(cells, lambda c: c["_g"].cast("int")).alias("_g"))

    def envelope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares = pa.array([_lower_envelope(g) for g in batch.column("_g").to_pylist()], pa.list_(pa.float64()))
            yield batch.set_column(batch.schema.get_field_index("_g"), "_g", squares)

    kind = T.StructType([*rows.schema.fields[:-1], T.StructField("_g", T.ArrayType(T.DoubleType()))])
    near = rows.mapInArrow(envelope, kind).select(*keys, *SIZE, "y", F.posexplode("_g").alias("x", "_g"))
    return near.select(*_px(keys), F.sqrt("_g").alias(name))
