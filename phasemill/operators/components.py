"""Connected components of pixel masks, for all recordings at once.

Pixels are first merged into horizontal runs with one window per image row, so the graph has one node
per run. Runs are resolved inside tiles of rows, one task's work of bounded size; what touches across tile
borders is contracted by alternating large-star and small-star steps (min-label joins), whose rounds grow
with the logarithm of the number of tiles that a component crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasemill.operators.blocks import index_rows
from phasemill.operators.stencil import SIZE
from phasemill.session import cut

REC = ["rec_id"]
TILE_ROWS = 64  # image rows whose runs are resolved in one task


def _merge_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node ids and the smallest id each is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[ia], lab[ib])
        new = lab.copy()
        np.minimum.at(new, lab[ia], low)
        np.minimum.at(new, lab[ib], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, lab):
            return nodes, nodes[lab]
        lab = new


def tile_roots(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node id of the component of every node that has an edge.

    `edges` has the key columns, two BIGINT node ids `a`, `b` and their tiles `ta`, `tb`. Edges inside a tile
    are resolved in its task; the roots of tiles are then joined along the edges between tiles. Returns
    (keys, node, root).
    """
    keys = list(keys)
    e = cut(edges.filter("a <> b").select(*keys, "a", "b", "ta", "tb"))

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        node, root = _merge_labels(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        out = {k: [pdf[k].iloc[0]] * len(node) for k in keys}
        return pd.DataFrame({**out, "node": node, "root": root})

    schema = T.StructType(
        [e.schema[k] for k in keys] + [T.StructField("node", T.LongType()), T.StructField("root", T.LongType())]
    )
    inside = e.filter("ta = tb").select(*keys, "ta", "a", "b")
    local = cut(inside.groupBy(*keys, "ta").applyInPandas(resolve, schema))
    across = e.filter("ta <> tb").select(*keys, "a", "b").distinct()
    if across.isEmpty():
        return local
    for end in ("a", "b"):  # a run without an edge in its own tile is its own root
        known = local.select(*keys, F.col("node").alias(end), F.col("root").alias("_r"))
        across = across.join(known, [*keys, end], "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    top = cut(star_roots(across, keys)).select(*keys, F.col("node").alias("root"), F.col("root").alias("_top"))
    lifted = local.join(top, [*keys, "root"], "left").select(*keys, "node", F.coalesce("_top", "root").alias("root"))
    alone = top.select(*keys, F.col("root").alias("node"), F.col("_top").alias("root"))
    return lifted.unionByName(alone.join(local.select(*keys, "node"), [*keys, "node"], "left_anti"))


def star_roots(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node id of the component of every node of edges (keys, a, b), by joins alone.

    Every round but the last lowers a label, so the rounds end by themselves.
    """
    keys = list(keys)
    e = cut(
        edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def tips(df, node, other):
        return df.groupBy(*keys, node).agg(F.min(other).alias("m"))

    mark = _fingerprint(e, keys)
    while mark[0]:
        both = e.select(*keys, "u", "v").union(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        m = tips(both, "u", "v").withColumn("m", F.least("m", "u"))
        # large star: every larger neighbour points at the smallest one
        large = (
            both.filter("v > u").join(m, [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: a node and its smaller neighbours point at the smallest of them
        m2 = tips(large, "u", "v")
        small = large.join(m2, [*keys, "u"]).select(
            *keys, F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("_e")
        )
        e = cut(
            small.select(*keys, F.col("_e.v").alias("u"), F.col("_e.m").alias("v")).filter("u <> v").distinct()
        )
        new = _fingerprint(e, keys)
        if new == mark:
            break
        mark = new
    nodes = e.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    roots = e.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)


def _fingerprint(e: DataFrame, keys: Sequence[str]) -> tuple:
    row = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys, "u", "v")).alias("h")).first()
    return row["n"], row["h"]


def _runs(mask: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """Adds `node`: scan position of the first pixel of the pixel's horizontal run."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    joined = F.col("x") - F.lag("x").over(w) == 1
    for c in same:
        joined = joined & F.col(c).eqNullSafe(F.lag(c).over(w))
    start = F.when(F.coalesce(joined, F.lit(False)), F.lit(None)).otherwise(F.col("x"))
    first = F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        mask.withColumn("_s", start)
        .withColumn("node", F.col("y").cast("bigint") * F.col("width") + first)
        .drop("_s")
    )


def component_roots(
    mask: DataFrame, conn: int = 4, keys: Sequence[str] = REC, same: Sequence[str] = (),
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Every set pixel with `root`, the scan position of the first pixel of its component.

    `same` restricts connections to pixels that agree in these columns (flat zones, labels).
    """
    keys = list(keys)
    own = [f"_key{i}" for i in range(len(keys))]  # a key may be called like an end of an edge
    plain = [F.col(k).alias(o) for k, o in zip(keys, own)]
    runs = _runs(mask, keys, same)
    up = Window.partitionBy(*keys, "x").orderBy("y")
    touch = F.col("y") - F.lag("y").over(up) == 1
    for c in same:
        touch = touch & F.col(c).eqNullSafe(F.lag(c).over(up))
    above = F.lag("node").over(up)
    edges = (
        runs.withColumn("_up", F.when(touch, above)).filter("_up IS NOT NULL")
        .select(*plain, F.col("node").alias("a"), F.col("_up").alias("b"), "y", (F.col("y") - 1).alias("_y2")).distinct()
    )
    if conn == 8:
        sel = [*keys, "y", "x", *same]
        down = runs.select(
            *keys, (F.col("y") + 1).alias("y"), F.explode(F.array(F.col("x") - 1, F.col("x") + 1)).alias("x"),
            *same, F.col("node").alias("_to"), F.col("y").alias("_y2"),
        )
        on = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in (*keys, "y", "x")]
        on += [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in same]
        diag = (
            runs.select(*sel, F.col("node").alias("_from")).alias("p").join(down.alias("q"), on)
            .select(*[F.col(f"p.{k}").alias(o) for k, o in zip(keys, own)], F.col("_from").alias("a"), F.col("_to").alias("b"), F.col("p.y").alias("y"), F.col("q._y2").alias("_y2")).distinct()
        )
        edges = edges.union(diag)
    tiled = edges.select(*own, "a", "b", *[F.floor(F.col(y) / tile_rows).alias(t) for y, t in (("y", "ta"), ("_y2", "tb"))])
    roots = tile_roots(tiled, own).withColumnsRenamed(dict(zip(own, keys)))
    out = runs.join(roots, [*keys, "node"], "left")
    return out.withColumn("root", F.coalesce("root", "node")).drop("node")


def label_components(
    mask: DataFrame, conn: int = 4, keys: Sequence[str] = REC, order: str = "row",
    same: Sequence[str] = (), name: str = "label", tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Labels 1..N per key in first-encounter order of a row-wise or column-wise scan."""
    keys = list(keys)
    px = component_roots(mask, conn, keys, same, tile_rows)
    first = (
        F.min(F.struct(F.col("y").alias("_a"), F.col("x").alias("_b")))
        if order == "row"
        else F.min(F.struct(F.col("x").alias("_a"), F.col("y").alias("_b")))
    )
    comps = px.groupBy(*keys, "root").agg(first.alias("_f")).select(
        *keys, "root", F.col("_f._a").alias("_a"), F.col("_f._b").alias("_b")
    )
    ranked = index_rows(comps, keys, "_a", ["_b"], name, start=1)
    ranked = ranked.select(*keys, "root", F.col(name).cast("int").alias(name))
    return px.join(ranked, [*keys, "root"]).drop("root")


def component_sizes(labelled: DataFrame, keys: Sequence[str] = REC, label: str = "label") -> DataFrame:
    return labelled.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("area_px"))


def largest_component(mask: DataFrame, conn: int = 4, keys: Sequence[str] = REC) -> DataFrame:
    """Pixels of the largest component per key; equal sizes keep the one met first in the scan."""
    keys = list(keys)
    px = component_roots(mask, conn, keys)
    sizes = px.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("_n"))
    # min of (-size, root) instead of a window, so that the choice is a partial aggregation
    best = sizes.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), "root")).alias("_best")).select(
        *keys, F.col("_best.root").alias("root")
    )
    return px.join(best, [*keys, "root"], "left_semi").drop("root")


def small_patch_filter(labelled: DataFrame, min_px: int, keys: Sequence[str] = REC, label: str = "label") -> DataFrame:
    big = component_sizes(labelled, keys, label).filter(F.col("area_px") >= min_px)
    return labelled.join(big, [*keys, label], "left_semi")


def components_touching(labelled: DataFrame, seed: DataFrame, keys: Sequence[str] = REC, label: str = "label") -> DataFrame:
    """Pixels of the labels that overlap the seed mask."""
    px = [*keys, "y", "x"]
    hit = labelled.join(seed.select(*px), px, "left_semi").select(*keys, label).distinct()
    return labelled.join(hit, [*keys, label], "left_semi")


def patch_count_guard(patches: DataFrame, limit: int = 100) -> DataFrame:
    """Adds `noisy`: the recording has more patches than can be meant."""
    n = patches.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_patches"))
    return patches.join(n, REC).withColumn("noisy", F.col("n_patches") > limit)


def frame_pixels(dims: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    """Every pixel of every frame in `dims` (keys, height, width)."""
    rows = dims.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)))
    return rows.repartition(*keys, "y").select(
        *keys, *SIZE, "y", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)).alias("x")
    )
