"""Splitting and merging of areas: minima, flooding, reconstruction, coverage.

Flood levels and reconstructions are spread inside bands of image rows, which exchange their border rows; a pixel
then belongs to the neighbour whose turn came first. All patches of all recordings advance together, and leave
when settled.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasemill.functions.columns import ecc_alt, finite
from phasemill.operators import areas, maps, quantiles, stats, stencil, tileflood
from phasemill.operators import components as cc
from phasemill.operators import morphology as mo
from phasemill.operators.stencil import REC, SIZE, box3, cross, scatter_spans
from phasemill.session import BROADCAST_BYTES, cut, join_small, row_width

def _ring(conn: int) -> list[stencil.Span]:
    return box3() if conn == 8 else cross(1)


def _px(keys: Sequence[str]) -> list[str]:
    return [*keys, *SIZE, "y", "x"]


# ---- minima ----------------------------------------------------------------------------------------


def regional_minima(df: DataFrame, value: str, conn: int = 8, keys: Sequence[str] = REC) -> DataFrame:
    """Pixels of the flat zones that have no strictly lower neighbour."""
    keys = list(keys)
    low = scatter_spans(df, _ring(conn), keys, [value]).groupBy(*_px(keys)).agg(F.min(value).alias("_low"))
    zones = cc.component_roots(df.select(*_px(keys), value), conn, keys, same=[value])
    j = zones.join(low, _px(keys))
    flat = j.groupBy(*keys, "root").agg(F.max(F.col("_low") < F.col(value)).alias("_down")).filter("NOT _down")
    return j.join(flat, [*keys, "root"], "left_semi").select(*_px(keys))


def progressive_minima(df: DataFrame, value: str, step: float, keys: Sequence[str] = REC) -> DataFrame:
    """Labels of `value ≤ cut` at the first cut (from min − step upward) with two components, else at the last.

    All cuts are labelled together; their number is the value range over the step.
    """
    keys = list(keys)
    v = df.filter(finite(value)).select(*_px(keys), F.col(value).alias("_v"))
    r = v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    j = v.join(r, keys)
    start = F.col("_lo") - step
    last = F.floor((F.col("_hi") + step - start) / step + 1e-9).cast("int")
    first = F.greatest(F.ceil((F.col("_v") - start) / step - 1e-9).cast("int"), F.lit(0))
    cuts = j.filter(first <= last).select(*_px(keys), F.explode(F.sequence(first, last)).alias("_cut"))
    lab = cut(cc.component_roots(cuts, 4, [*keys, "_cut"]))
    n = lab.groupBy(*keys, "_cut").agg(F.count_distinct("root").alias("_n"))
    pick = n.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_n") >= 2, F.col("_cut"))), F.max("_cut")).alias("_cut")
    )
    chosen = lab.join(pick, [*keys, "_cut"], "left_semi").drop("_cut")
    order = chosen.select(*keys, "root").distinct()
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("root")  # the markers of one patch
    rank = order.withColumn("label", F.row_number().over(w))
    return chosen.join(rank, [*keys, "root"]).drop("root")


# ---- flooding ----------------------------------------------------------------------------------------


def basin_assign(df: DataFrame, elevation: str, marker: str, conn: int = 8, keys: Sequence[str] = REC) -> DataFrame:
    """Flood from the markers inside the given pixels.

    `df` holds the mask's pixels with the elevation and the marker label (0 or null for none). Returns the
    pixels with `basin` (null if unreachable), `level` and `hops`.

    Levels are exact minimax levels, `hops` the steps taken since the level last rose. Fronts advance in the
    order (level, hops, y, x); a pixel belongs to the neighbour whose turn came first, and through it to a
    marker. These parents form trees, so every basin is connected to its marker; their roots are found by
    pointer doubling.
    """
    keys = list(keys)
    seeded = (F.coalesce(F.col(marker), F.lit(0)) > 0) & finite(elevation)
    cost = F.struct(F.col(elevation).cast("double").alias("level"), F.lit(0).alias("hops"))
    base = cut(
        df.select(
            *_px(keys), F.coalesce(F.col(elevation).cast("double"), F.lit(float("nan"))).alias("_e"),
            F.when(seeded, F.col(marker).cast("bigint")).alias("_seed"), F.when(seeded, cost).alias("_c"),
        )
    )
    sources = base.select(
        *_px(keys), F.when(finite("_e"), F.col("_e")).alias("_e"), F.col("_c.level").alias("level"), F.col("_c.hops").alias("hops")
    )
    reached = tileflood.spread(sources, conn, keys)
    costs = reached.select(
        *_px(keys), F.when(F.col("level").isNotNull(), F.struct("level", "hops")).alias("_c")
    ).join(base.select(*keys, "y", "x", "_e", "_seed"), [*keys, "y", "x"])
    flooded = cut(costs.withColumn("_at", F.col("y").cast("bigint") * F.col("width") + F.col("x")))
    done = _owners(flooded, conn, keys)
    return flooded.join(done, [*keys, "_at"], "left").select(
        *_px(keys), F.col("_e").alias(elevation), "basin", "_c.level", "_c.hops"
    )


def _owners(flooded: DataFrame, conn: int, keys: list[str]) -> DataFrame:
    """(keys, _at, basin): each reached pixel follows its first neighbour's turn until a marker."""
    live = flooded.filter("_c IS NOT NULL")
    turn = F.struct(F.col("_c.level").alias("level"), F.col("_c.hops").alias("hops"), "y", "x", "_at")
    near = scatter_spans(live.withColumn("_t", turn), _ring(conn), keys, ["_t"])
    own = live.filter("_seed IS NULL").select(*keys, "y", "x", "_at")
    first = near.join(own, [*keys, "y", "x"]).filter("_t._at <> _at").groupBy(*keys, "_at").agg(F.min("_t").alias("_t"))
    links = cut(first.select(*keys, "_at", F.col("_t._at").alias("_up")))
    out = live.filter("_seed IS NOT NULL").select(*keys, "_at", F.col("_seed").alias("basin"))
    while not links.isEmpty():
        # pixels that point at a settled one are settled; the others point twice as far
        settled = out.select(*keys, F.col("_at").alias("_up"), "basin")
        new = cut(links.join(settled, [*keys, "_up"]).select(*keys, "_at", "basin"))
        rest = links.join(settled, [*keys, "_up"], "left_anti")
        jump = links.select(*keys, F.col("_at").alias("_up"), F.col("_up").alias("_next"))
        links = cut(rest.join(jump, [*keys, "_up"]).select(*keys, "_at", F.col("_next").alias("_up")))
        out = out.unionByName(new)
    return out


def basin_lines(df: DataFrame, elevation: str, conn: int = 4, keys: Sequence[str] = REC) -> DataFrame:
    """Basins of the regional minima with the divides between them as `basin` 0.

    A pixel is a divide when two basins have reached it before its own turn (by level, steps, scan order).
    """
    keys = list(keys)
    minima = cc.label_components(regional_minima(df, elevation, conn, keys), conn, keys, "col", name="_m")
    seeded = df.join(minima.select(*keys, "y", "x", "_m"), [*keys, "y", "x"], "left")
    b = cut(basin_assign(seeded, elevation, "_m", conn, keys))
    return mark_divides(b, conn, keys)


def mark_divides(basins: DataFrame, conn: int, keys: Sequence[str]) -> DataFrame:
    """Set `basin` to 0 where two basins had arrived next to a pixel before its own turn."""
    turn = F.struct("level", "hops", "y", "x")
    near = scatter_spans(basins.withColumn("_t", turn), _ring(conn), keys, ["_t", "basin"])
    j = near.join(basins.select(*keys, "y", "x", turn.alias("_own")), [*keys, "y", "x"]).filter("_t < _own")
    line = j.groupBy(*keys, "y", "x").agg(F.min("basin").alias("_a"), F.max("basin").alias("_b")).filter("_a <> _b")
    out = basins.join(line.select(*keys, "y", "x", F.lit(True).alias("_line")), [*keys, "y", "x"], "left")
    return out.withColumn("basin", F.when(F.col("_line"), F.lit(0)).otherwise(F.col("basin"))).drop("_line")


def reconstruct_erosion(df: DataFrame, marker: str, mask: str, conn: int = 8, keys: Sequence[str] = REC) -> DataFrame:
    """Repeat max(erosion(J), mask) from J = max(marker, mask) to stability; result column `level`."""
    keys = list(keys)
    start = F.greatest(marker, mask)
    # a NaN is above all numbers: such a mask is a wall, such a start is no source; a null mask holds nothing back
    wall = F.when(F.isnan(mask), F.lit(None)).otherwise(F.coalesce(F.col(mask), F.lit(float("-inf"))))
    source = F.when(~F.isnan(start), start)
    base = df.select(*_px(keys), wall.cast("double").alias("_e"), source.cast("double").alias("level"), F.lit(0).alias("hops"), start.alias("_start"))
    low = tileflood.spread(base, conn, keys, count_hops=False).select(*_px(keys), F.col("level").alias("_low"))
    return base.select(*_px(keys), "_start").join(low, _px(keys)).select(*_px(keys), F.coalesce("_low", "_start").alias("level"))


def impose_minima(df: DataFrame, value: str, at: str, keys: Sequence[str] = REC) -> DataFrame:
    """Raise the surface so that its only minima are the pixels where `at` holds."""
    keys = list(keys)
    v = F.when(finite(value), F.col(value))
    r = df.groupBy(*keys).agg(((F.max(v) - F.min(v)) / 1000.0).alias("_d"))
    inf = float("inf")
    j = df.join(r, keys).withColumn("_f", F.when(F.col(at), F.lit(-inf)).otherwise(F.lit(inf)))
    j = j.withColumn("_g", F.least(F.col(value) + F.col("_d"), F.col("_f")))
    return reconstruct_erosion(j, "_f", "_g", 8, keys)


# ---- coverage ----------------------------------------------------------------------------------------

SPHERE_MIN, SPHERE_CELLS = -90, 181


def coverage(
    df: DataFrame, azi: str, alt: str, jac: str, px_per_mm: float | Column, keys: Sequence[str] = ("rec_id", "patch")
) -> tuple[DataFrame, DataFrame]:
    """(statistics, cells) of the visual field each patch covers on a 1° grid.

    Only pixels whose Jacobian has the sign of the patch's mean Jacobian count. Those that lie beyond ±90°, or have no
    position, fill no cell: `n_outside` counts them.
    """
    keys = list(keys)
    scale = px_per_mm if isinstance(px_per_mm, Column) else F.lit(float(px_per_mm))
    p = stencil.frame_stats(df, {"_mj": F.avg(jac)}, keys)
    kept = p.filter((F.signum(jac) == F.signum("_mj")) & (F.col(jac) != 0))
    last = SPHERE_MIN + SPHERE_CELLS - 1
    inside = F.coalesce(F.round(alt).between(SPHERE_MIN, last) & F.round(azi).between(SPHERE_MIN, last), F.lit(False))
    s = kept.groupBy(*keys).agg(
        F.sum(F.abs(jac) / (scale * scale)).alias("jac_coverage"), F.count(F.lit(1)).alias("_kept"),
        F.count_if(~inside).alias("_outside"),
    )
    cell = kept.filter(inside).select(
        *keys, F.lit(SPHERE_CELLS).alias("height"), F.lit(SPHERE_CELLS).alias("width"),
        (F.round(alt).cast("int") - SPHERE_MIN).alias("y"), (F.round(azi).cast("int") - SPHERE_MIN).alias("x"),
    ).distinct()
    cells = cut(mo.fill_holes(cut(mo.closing(mo.fill_holes(cut(cell), keys), "cross", 1, keys)), keys))
    n = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = df.select(*keys).distinct().join(s, keys, "left").join(n, keys, "left")
    actual = F.coalesce("_n", F.lit(0)).cast("double")
    return out.select(
        *keys, F.coalesce("jac_coverage", F.lit(0.0)).alias("jac_coverage"), actual.alias("actual_coverage"),
        F.try_divide(actual, "_kept").alias("mag_factor"), F.coalesce("_outside", F.lit(0)).alias("n_outside"),
    ), cells


# ---- pairs -------------------------------------------------------------------------------------------


HEAD_PAIRS = 20_000


def _take_in_order(pairs: pa.Table) -> pa.Table:
    """The pairs of one recording that are taken when they are met in the order of their rank."""
    used, keep = set(), []
    rows = pairs.sort_by("_n")
    for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist()):
        free = a not in used and b not in used
        keep.append(free)
        if free:
            used.update((a, b))
    return rows.filter(pa.array(keep, pa.bool_())).drop_columns(["_n"])


def _not_used(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    used = cut(taken.select("rec_id", F.explode(F.array("a", "b")).alias("_p")))
    fits = used.count() * row_width(used.schema) <= BROADCAST_BYTES
    for end in ("a", "b"):
        at = used.withColumnRenamed("_p", end)
        pairs = pairs.join(F.broadcast(at) if fits else at, ["rec_id", end], "left_anti")
    return pairs


def greedy_pairs(
    candidates: DataFrame, order: Sequence[str] = ("ratio", "neg_area"), head: int = HEAD_PAIRS
) -> DataFrame:
    """Take pairs in ascending order, each patch at most once. (a, b) closes the order, which makes it total.

    A pair that is given more than once counts where it comes first. The pairs are sorted once, by ranges, and go by
    a number from then on. A round settles the first pairs of every recording in order, which is exact for a prefix
    of the order, whatever chains of pairs it holds. If pairs are left, those that rank first at both of their ends
    follow, all at once. `head` bounds the rows of a task and changes no result: a prefix ends with the block of
    numbers, a quarter of `head` or less, in which it holds that many pairs.
    """
    ranked = candidates.select("rec_id", "a", "b", *order).sort("rec_id", *order, "a", "b")
    left = cut(ranked.select("rec_id", "a", "b", F.monotonically_increasing_id().alias("_n")))
    block = F.shiftright("_n", max(head.bit_length() - 3, 0))  # numbers of one task are consecutive
    before = Window.partitionBy("rec_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    pairs = T.StructType([left.schema["rec_id"], left.schema["a"], left.schema["b"]])
    taken = None
    while left.take(1):
        blocks = left.groupBy("rec_id", block.alias("_block")).agg(F.count(F.lit(1)).alias("_k"))
        blocks = blocks.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).filter(F.col("_before") < head)
        first = join_small(left, blocks.groupBy("rec_id").agg(F.max("_block").alias("_last")), REC).filter(block <= F.col("_last"))
        won = cut(first.select("rec_id", "a", "b", "_n").groupBy("rec_id").applyInArrow(_take_in_order, pairs))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(_not_used(left, won))
        # the number and the end in one, so that the least of a patch is a plain number
        side = F.posexplode(F.array("a", "b")).alias("_end", "_p")
        ends = left.select("rec_id", "_n", side).select("rec_id", "_p", (F.col("_n") * 2 + F.col("_end")).alias("_r"))
        # moved before they are grouped: a task that reads them meets nearly as many patches as rows
        best = ends.repartition("rec_id", "_p").groupBy("rec_id", "_p").agg(F.min("_r").alias("_r"))
        is_b = F.col("_r") % 2 == 1
        both = best.groupBy("rec_id", F.shiftright("_r", 1).alias("_n")).agg(
            F.count(F.lit(1)).alias("_k"), F.max(F.when(~is_b, F.col("_p"))).alias("a"), F.max(F.when(is_b, F.col("_p"))).alias("b")
        )
        won = cut(both.filter("_k = 2").select("rec_id", "a", "b"))
        taken = taken.unionByName(won)
        left = cut(_not_used(left, won))
    return candidates.limit(0).select("rec_id", "a", "b") if taken is None else taken


# ---- split and merge -----------------------------------------------------------------------------------


def _patch_borders(px: DataFrame, region: str) -> DataFrame:
    """The one-pixel ring around every region of a patch."""
    keys = ["rec_id", "patch", region]
    ring = mo.dilate(px, "cross", 1, keys)
    return mo.mask_minus(ring, px, keys).select(*_px(["rec_id", "patch"])).distinct()


def split_patches(
    patches: DataFrame, frame: DataFrame, grid: DataFrame, *, azi: str, alt: str, det: str, overlap: float = 1.1,
    cut_step: float = 5.0, size: float = 0.5, close_n: int = 15, box: int = 10, border_width: int = 1, codes=None,
) -> DataFrame:
    """Cut patches that cover their visual area more than `overlap` times along their eccentricity basins."""
    pk = ["rec_id", "patch"]
    pos = frame.select("rec_id", "y", "x", azi, alt, det)
    px = patches.select(*_px(pk), "sign").join(pos, ["rec_id", "y", "x"])
    area = areas.visual_area(areas.project_visual(px, grid, alt, azi, size, close_n), size)
    bad = pos.groupBy("rec_id").agg(F.max(F.isnan(det)).alias("_bad"))
    s = px.groupBy(*pk).agg(F.sum(F.nanvl(det, F.lit(0.0))).alias("_s")).join(bad, REC)
    over = s.join(area, pk).filter(
        ~F.col("_bad") & (F.col("visual_area") > 1e-9) & (F.col("_s") / F.col("visual_area") >= overlap)
    ).select(*pk)
    todo = cut(px.join(over, pk, "left_semi"))
    if not todo.take(1):
        return patches.select(*_px(pk), "sign")
    ok_alt, ok_azi = finite(alt) & (F.col(alt) != 0), finite(azi) & (F.col(azi) != 0)
    centre = todo.groupBy(*pk).agg(
        F.coalesce(F.avg(F.when(ok_alt, F.col(alt))), F.lit(0.0)).alias("_ca"),
        F.coalesce(F.avg(F.when(ok_azi, F.col(azi))), F.lit(0.0)).alias("_cz"),
    )
    # eccentricity around the patch, far enough out for the box filter
    reach = [(dy, -box, box) for dy in range(-box, box + 1)]
    around = scatter_spans(todo, reach, pk).distinct().join(pos, ["rec_id", "y", "x"]).join(centre, pk)
    ecc = around.select(*_px(pk), ecc_alt(alt, azi, "_ca", "_cz").alias("ecc"))
    soft = stencil.box_filter(ecc, ["ecc"], box, pk)
    inside = cut(soft.join(todo.select(*pk, "y", "x"), [*pk, "y", "x"], "left_semi"))
    marks = progressive_minima(inside, "ecc", cut_step, pk)
    many = marks.groupBy(*pk).agg(F.max("label").alias("_m")).filter("_m >= 2").select(*pk)
    seeded = inside.join(many, pk, "left_semi").join(marks.select(*pk, "y", "x", "label"), [*pk, "y", "x"], "left")
    basins = basin_assign(seeded, "ecc", "label", 8, pk).filter("basin IS NOT NULL")
    whole = todo.join(many, pk, "left_semi").withColumn("_one", F.lit(0).cast("bigint"))
    rings = _patch_borders(basins.withColumnRenamed("basin", "_one"), "_one").union(_patch_borders(whole, "_one")).distinct()
    line = mo.skeletonize(rings, pk, codes)
    if border_width > 1:
        line = mo.dilate(line, "cross", border_width - 1, pk)
    grown = mo.dilate(whole, "cross", 1, pk)
    pieces = cc.label_components(cut(mo.mask_minus(grown, line, pk)), 4, pk, name="_piece")
    pieces = cut(mo.mask_and(pieces, whole.select(*_px(pk)), pk))
    real = pieces.groupBy(*pk).agg(F.count_distinct("_piece").alias("_k")).filter("_k >= 2").select(*pk)
    new = pieces.join(real, pk, "left_semi").join(todo.select(*pk, "sign").distinct(), pk)
    # new ids keep the order: patch, then piece
    old = patches.select(*_px(pk), "sign").join(real, pk, "left_anti").withColumn("_piece", F.lit(0))
    return _renumber(old.unionByName(new.select(*_px(pk), "sign", "_piece")), ["patch", "_piece"])


def _renumber(px: DataFrame, by: Sequence[str]) -> DataFrame:
    from pyspark.sql import Window

    ids = px.select("rec_id", *by).distinct()
    w = Window.partitionBy("rec_id").orderBy(*by)  # patches of one recording, at most a few hundred
    ids = ids.withColumn("_new", F.row_number().over(w))
    return px.join(ids, ["rec_id", *by]).drop(*by).withColumnRenamed("_new", "patch").select(
        *_px(["rec_id", "patch"]), "sign"
    )


def merge_patches(
    patches: DataFrame, frame: DataFrame, grid: DataFrame, *, azi: str, alt: str, overlap: float = 0.01,
    size: float = 0.5, close_n: int = 15, border_width: int = 1,
) -> DataFrame:
    """Join adjacent patches of one sign whose visual fields hardly overlap, best pairs first, until none is left."""
    pk = ["rec_id", "patch"]
    pos = frame.select("rec_id", "y", "x", azi, alt)
    cur = cut(patches.select(*_px(pk), "sign"))
    while True:  # every round but the last takes at least one patch away
        near = areas.adjacent_patches(cur, max(border_width + 1, 2))
        sign = cur.select("rec_id", "patch", "sign").distinct()
        near = near.join(sign.select("rec_id", F.col("patch").alias("a"), F.col("sign").alias("_sa")), ["rec_id", "a"])
        near = near.join(sign.select("rec_id", F.col("patch").alias("b"), F.col("sign").alias("_sb")), ["rec_id", "b"])
        near = cut(near.filter("_sa = _sb").select("rec_id", "a", "b", F.col("_sa").alias("sign")))
        if not near.take(1):
            return cur
        ends = near.select("rec_id", "a", "b", F.explode(F.array("a", "b")).alias("patch"))
        joined = cur.join(ends, pk).select("rec_id", "a", "b", *SIZE, "y", "x").distinct()
        ab = ["rec_id", "a", "b"]
        merged = cut(mo.closing(joined, "cross", max(border_width, 1), ab))
        whole = cc.component_roots(merged, 4, ab).groupBy(*ab).agg(F.count_distinct("root").alias("_k")).filter("_k = 1")
        shape = merged.withColumn("patch", F.struct("a", "b"))
        m_area = areas.visual_area(
            areas.project_visual(shape.join(pos, ["rec_id", "y", "x"]), grid, alt, azi, size, close_n), size
        ).select("rec_id", F.col("patch.a").alias("a"), F.col("patch.b").alias("b"), (-F.col("visual_area")).alias("neg_area"))
        vs = cut(areas.project_visual(cur.join(pos, ["rec_id", "y", "x"]), grid, alt, azi, size, close_n))
        one = areas.visual_area(vs, size)
        shared = areas.patch_overlap(vs)
        c = near.join(whole.select(*ab), ab).join(m_area, ab).join(shared, ab, "left")
        c = c.join(one.select("rec_id", F.col("patch").alias("a"), F.col("visual_area").alias("_aa")), ["rec_id", "a"])
        c = c.join(one.select("rec_id", F.col("patch").alias("b"), F.col("visual_area").alias("_ab")), ["rec_id", "b"])
        common = F.coalesce("n_shared", F.lit(0)) * float(size) * float(size)
        c = c.filter("_aa >= 1e-9 AND _ab >= 1e-9").withColumn(
            "ratio", F.greatest(common / F.col("_aa"), common / F.col("_ab"))
        ).filter(F.col("ratio") <= overlap)
        chosen = cut(greedy_pairs(c.select("rec_id", "a", "b", "ratio", "neg_area")))
        if not chosen.take(1):
            return cur
        # merged patches come first, in the order in which they were accepted, then the others
        rank = F.struct(F.lit(0).alias("_late"), "ratio", "neg_area", "a", "b")
        order = chosen.join(c.select(*ab, "ratio", "neg_area"), ab).select(*ab, rank.alias("_order"))
        fresh = merged.join(order, ab).join(near.select(*ab, "sign"), ab).select(*_px(["rec_id"]), "_order", "sign")
        used = chosen.select("rec_id", F.explode(F.array("a", "b")).alias("patch"))
        late = F.struct(
            F.lit(1).alias("_late"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("neg_area"),
            F.col("patch").alias("a"), F.col("patch").alias("b"),
        )
        rest = cur.join(used, pk, "left_anti").select(*_px(["rec_id"]), late.alias("_order"), "sign")
        cur = cut(_renumber(rest.unionByName(fresh), ["_order"]))


def split_merge(
    patches: DataFrame, frame: DataFrame, *, azi: str = "azi_deg", alt: str = "alt_deg", det: str = "determinant",
    split_overlap: float = 1.1, cut_step: float = 5.0, merge_overlap: float = 0.01, size: float = 0.5,
    close_n: int = 15, box: int = 10, border_width: int = 1, min_px: int = 100, codes=None,
    noise_limit: int | None = None,
) -> DataFrame:
    """Split over-representing patches, merge fragments, drop small rests.

    With `noise_limit`, recordings of more patches pass through unchanged.
    """
    pk = ["rec_id", "patch"]
    calm, noisy = areas.calm_recordings(patches.select(*_px(pk), "sign"), noise_limit)
    calm = cut(calm)
    grid = cut(areas.visual_grid(frame, alt, azi, size))
    one = split_patches(
        calm, frame, grid, azi=azi, alt=alt, det=det, overlap=split_overlap, cut_step=cut_step, size=size,
        close_n=close_n, box=box, border_width=border_width, codes=codes,
    )
    two = merge_patches(
        one, frame, grid, azi=azi, alt=alt, overlap=merge_overlap, size=size, close_n=close_n, border_width=border_width
    )
    big = two.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_px).select(*pk)
    kept = two.join(big, pk, "left_semi")
    return kept.unionByName(noisy)


# ---- split and fuse ------------------------------------------------------------------------------------

# Fixed values of the procedure
SPLIT_RADIUS, KEEP_RADIUS = 30.0, 35.0
OVER_SPLIT, OVER_DROP, NEGLIGIBLE, FUSE_OVERLAP = 0.999, 1.05, 0.01, 0.1
LEVEL_FRACTIONS = {f"q{p}": p / 100.0 for p in range(2, 91, 10)}


def _fracture(patches: DataFrame, centre: DataFrame) -> DataFrame:
    """Replace each patch whose centre part falls into pieces by the basins of those pieces."""
    pk = ["rec_id", "patch"]
    core = cut(mo.opening(centre.select(*_px(pk)), "cross", 1, pk))
    seeds = cut(cc.label_components(core, 4, pk, name="_seed"))
    torn = seeds.groupBy(*pk).agg(F.max("_seed").alias("_k")).filter("_k >= 2").select(*pk)
    todo = cut(patches.select(*_px(pk)).join(torn, pk, "left_semi"))
    if not todo.take(1):
        return patches.select(*_px(pk))
    dims = todo.select(*pk, *SIZE).distinct()
    dist = mo.distance_to(core.join(torn, pk, "left_semi"), dims, pk)
    room = mo.dilate(todo, "cross", 1, pk)
    field = room.join(dist.select(*pk, "y", "x", "dist"), [*pk, "y", "x"]).join(
        seeds.select(*pk, "y", "x", "_seed"), [*pk, "y", "x"], "left"
    )
    basins = cut(basin_assign(field, "dist", "_seed", 4, pk).filter("basin IS NOT NULL"))
    inner = mark_divides(basins, 4, pk).filter("basin > 0").select(*_px(pk))
    return patches.select(*_px(pk)).join(torn, pk, "left_anti").union(mo.erode(inner, "cross", 1, pk))


def _relabel(px: DataFrame) -> DataFrame:
    return cut(cc.label_components(cut(px.select(*_px(REC)).distinct()), 4, REC, "col", name="patch"))


def local_minimum_centres(patches: DataFrame, distance: str, far: float) -> DataFrame:
    """Parts of each patch around the separate minima of a terraced distance map."""
    pk = ["rec_id", "patch"]
    q = quantiles.hazen_many(patches, pk, distance, LEVEL_FRACTIONS)
    j = patches.join(q, pk)
    names = list(LEVEL_FRACTIONS)
    v = F.col(distance)
    level = F.lit(0)
    on_edge = F.lit(False)
    for n in names:
        level = level + F.when(v > F.col(n), 1).otherwise(0)
        on_edge = on_edge | (v == F.col(n))
    j = j.withColumn("_bin", F.when(~on_edge, level))
    mean = j.filter("_bin IS NOT NULL").groupBy(*pk, "_bin").agg(F.avg(distance).alias("_m"))
    terr = j.join(mean, [*pk, "_bin"], "left").select(*_px(pk), F.coalesce("_m", distance).alias("_d"))
    top = terr.groupBy(*pk).agg(F.max("_d").alias("_top"), F.count(F.lit(1)).alias("_n"))
    ring = mo.dilate(terr, "disk", 7, pk)  # as far as the opening and the median can look
    wide = ring.join(terr.select(*pk, "y", "x", "_d"), [*pk, "y", "x"], "left").join(top, pk)
    flat = stencil.grey_open(wide.withColumn("_d", F.coalesce("_d", "_top")), "_d", 3, pk)
    inside = terr.select(*pk, "y", "x", F.lit(True).alias("_in"))
    rad = flat.join(inside, [*pk, "y", "x"], "left").select(
        *_px(pk), F.when(F.col("_in"), F.col("_d")).otherwise(F.lit(far)).alias("_d")
    )
    rad = cut(stencil.median3x3_grey(rad, "_d", pk).join(inside, [*pk, "y", "x"], "left"))
    low = mo.mask_and(regional_minima(rad.drop("_in"), "_d", 8, pk), rad.filter("_in"), pk)
    # the radius of the dilation grows with the patch, so patches are widened class by class
    low = cut(low.join(top.select(*pk, F.round(F.sqrt("_n") / 20.0).cast("int").alias("_r")), pk))
    marks = low.filter("_r = 0").select(*_px(pk))
    for (r,) in low.filter("_r > 0").select("_r").distinct().orderBy("_r").collect():  # a few radii
        marks = marks.union(mo.dilate(low.filter(F.col("_r") == r), "disk", r, pk))
    marks = mo.mask_and(marks.distinct(), terr, pk)
    seeds = cut(cc.label_components(cut(marks), 4, pk, name="_seed"))
    field = rad.filter("_in").join(seeds.select(*pk, "y", "x", "_seed"), [*pk, "y", "x"], "left")
    basins = cut(basin_assign(field, "_d", "_seed", 8, pk).filter("basin IS NOT NULL"))
    return mark_divides(basins, 8, pk).filter("basin > 0").select(*_px(pk))


def split_fuse(
    patches: DataFrame, frame: DataFrame, *, azi: str = "azi_deg", alt: str = "alt_deg", um_per_pixel: float | DataFrame = 20.0,
    opening_radius: int = 10, smooth_sigma: float = 2.0, noise_limit: int | None = None,
) -> DataFrame:
    """Limit areas to the central field, split those that represent it twice, drop redundant ones, fuse fragments.

    Works at the native resolution, with a wrapped Gaussian for the smoothed position maps. `um_per_pixel` is
    one number or a table (rec_id, um_per_pixel); recordings without one take 20. With `noise_limit`,
    recordings of more patches pass through unchanged.
    """
    pk = ["rec_id", "patch"]
    calm, noisy = areas.calm_recordings(patches, noise_limit)
    pos = frame.select(*_px(REC), azi, alt)
    im = cut(calm.select(*_px(REC)).distinct())
    labelled = pos.join(im.select("rec_id", "y", "x", F.lit(1).alias("_on")), ["rec_id", "y", "x"], "left").withColumn(
        "_on", F.coalesce("_on", F.lit(0))
    )
    ref = areas.v1_center_pixel_sample(labelled, alt, azi, "_on", opening_radius)
    soft = stencil.gaussian_smooth(pos, [azi, alt], smooth_sigma, border="wrap")
    g = stencil.gradient(soft, [azi, alt])
    if isinstance(um_per_pixel, DataFrame):
        scale = um_per_pixel.select("rec_id", F.col("um_per_pixel").cast("double").alias("_um"))
        g = join_small(g, scale, REC, "left").withColumn("_ppm", 1000.0 / F.coalesce("_um", F.lit(20.0)))
    else:
        g = g.withColumn("_ppm", F.lit(1000.0 / um_per_pixel))
    ppm = F.col("_ppm")
    jac = (F.col(f"{azi}_dx") * F.col(f"{alt}_dy") - F.col(f"{alt}_dx") * F.col(f"{azi}_dy")) * ppm * ppm
    info = g.select("rec_id", "y", "x", F.col(azi).alias("_z"), F.col(alt).alias("_a"), jac.alias("_j"), "_ppm").join(
        pos.select("rec_id", "y", "x", azi, alt), ["rec_id", "y", "x"]
    ).join(ref, REC, "left")
    ecc = F.coalesce(ecc_alt(alt, azi, "alt_c", "azi_c"), F.lit(0.0))
    info = cut(info.select("rec_id", "y", "x", "_z", "_a", "_j", "_ppm", azi, alt, ecc.alias("_ecc")))

    def placed(px):
        return px.join(info, ["rec_id", "y", "x"])

    cur = _relabel(mo.erode(mo.opening(im, "cross", 1), "cross", 1))
    # pass 1: the part within 30 degrees
    cur = _relabel(_fracture(cur, placed(cur).filter(F.col("_ecc") < SPLIT_RADIUS)))
    # pass 2: patches that cover their field more than once
    near = cut(placed(cur).filter(F.col("_ecc") < SPLIT_RADIUS))
    stats_, _ = coverage(near, "_z", "_a", "_j", ppm)
    twice = stats_.filter(F.col("jac_coverage") > F.col("actual_coverage") * OVER_SPLIT).select(*pk)
    over = cut(near.join(twice, pk, "left_semi"))
    if over.take(1):
        mz = quantiles.median(over, pk, azi, "_hc").drop("n")
        ma = quantiles.median(over, pk, alt, "_vc").drop("n")
        away = over.join(mz, pk).join(ma, pk)
        dz, da = F.col(azi) - F.col("_hc"), F.col(alt) - F.col("_vc")
        away = cut(away.select(*_px(pk), F.sqrt(dz * dz + da * da).alias("_far")))
        cur = _relabel(_fracture(cur, local_minimum_centres(away, "_far", SPLIT_RADIUS)))
    # pass 3: redundant or negligible patches
    wide = cut(placed(cur).filter(F.col("_ecc") < KEEP_RADIUS))
    stats_, _ = coverage(wide, "_z", "_a", "_j", ppm)
    whole = 3.141592653589793 * KEEP_RADIUS * KEEP_RADIUS
    keep = stats_.filter(
        (F.col("jac_coverage") <= F.col("actual_coverage") * OVER_DROP) & (F.col("jac_coverage") / whole >= NEGLIGIBLE)
    ).select(*pk)
    cur = cut(cur.join(keep, pk, "left_semi"))
    cur = _fuse(cur, info, azi, alt, frame, ppm)
    sign = maps.field_sign_from_positions(pos, azi, alt)
    out = areas.sign_patches(cur.select(*_px(REC)), sign, "sign").select(*_px(pk), "sign")
    return out.unionByName(noisy.select(*_px(pk), "sign"))


def _fuse(cur: DataFrame, info: DataFrame, azi: str, alt: str, frame: DataFrame, ppm: Column) -> DataFrame:
    """Unite touching patches of one sign that share little of the visual field, least overlap first."""
    pk, ab = ["rec_id", "patch"], ["rec_id", "a", "b"]
    sign = cut(maps.field_sign_from_positions(frame.select(*_px(REC), azi, alt), azi, alt).select("rec_id", "y", "x", "sign"))
    while True:  # every round but the last leaves fewer patches
        if not cur.take(1):
            return cur
        s = cut(stats.area_stats(cur.join(sign.withColumnRenamed("sign", "_v"), ["rec_id", "y", "x"]), "_v", "patch"))
        wide = mo.dilate(cur, "disk", 1, pk).join(info, ["rec_id", "y", "x"])
        _, cells = coverage(wide, "_z", "_a", "_j", ppm)
        n = cells.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n"))
        touch = areas.pairs_on(mo.dilate(cur, "disk", 3, pk), ["y", "x"], "patch").distinct()
        shared = areas.patch_overlap(cells)

        def end(df, side, col):
            return df.select("rec_id", F.col("patch").alias(side), F.col(col).alias(f"_{col}_{side}"))

        c = touch.join(shared, ab, "left")
        for side in ("a", "b"):
            c = c.join(end(s, side, "sign"), ["rec_id", side]).join(end(n, side, "_n"), ["rec_id", side], "left")
        small = F.least(F.coalesce("__n_a", F.lit(0)), F.coalesce("__n_b", F.lit(0)))
        ratio = F.when(small > 0, F.coalesce("n_shared", F.lit(0)) / small).otherwise(0.0)
        c = c.filter("_sign_a = _sign_b").select(*ab, ratio.alias("ratio"), (-small).alias("neg_area"))
        chosen = cut(greedy_pairs(c.filter(F.col("ratio") < FUSE_OVERLAP)))
        if not chosen.take(1):
            return cur
        ends = chosen.select(*ab, F.explode(F.array("a", "b")).alias("patch"))
        pair = cur.join(ends, pk)
        union = cut(mo.closing(pair.select(*ab, *SIZE, "y", "x"), "disk", 5, ab))
        # keep clear of every other patch: a pixel within reach of a patch that is not one of the two
        guard = mo.dilate(cur, "disk", 1, pk).select("rec_id", "y", "x", "patch")
        clash = union.join(guard, ["rec_id", "y", "x"]).filter("patch <> a AND patch <> b").select(*ab, "y", "x").distinct()
        fused = union.join(clash, [*ab, "y", "x"], "left_anti").select(*_px(REC))
        rest = cur.join(ends.select(*pk), pk, "left_anti").select(*_px(REC))
        before = cur.select(*pk).distinct().count()
        new = _relabel(mo.opening(cut(rest.union(fused).distinct()), "cross", 1))
        if new.select(*pk).distinct().count() >= before:
            return new  # nothing grew together, so another round would choose the same pairs
        cur = new
