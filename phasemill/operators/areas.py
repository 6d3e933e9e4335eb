"""From a sign map to labelled areas and their maps: cortex masks, thresholds, patches, eccentricity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.functions.columns import ecc_alt, ecc_azi, finite, label_roi, magnification_factor, polar_angle
from phasemill.operators import components as cc
from phasemill.operators import morphology as mo
from phasemill.operators import stats, stencil
from phasemill.session import cut, join_small

REC = ["rec_id"]
PIX = ["rec_id", "height", "width", "y", "x"]


# ---- cortex and threshold ---------------------------------------------------------------------------


def cortex_mask(
    df: DataFrame, method: str = "sigma_bound", *, threshold: float = 0.5, k: float = 1.5, close: int = 10,
    dilate: int = 3, exponent: float = 1.0, sign: str = "vfs_smooth",
    reliability: Sequence[str] = ("rel_azi_fwd", "rel_azi_rev", "rel_alt_fwd", "rel_alt_rev"),
    magnitude: str = "magnitude",
) -> DataFrame:
    """Sparse mask of the responsive cortex: reliability, sigma_bound, magnitude or none."""
    if method == "none":
        return df.select(*PIX)
    if method == "reliability":
        low = F.least(*[F.col(c) for c in reliability])
        raw = df.filter(finite(low) & (low >= threshold)).select(*PIX)
        return mo.fill_holes(cut(cc.largest_component(raw)))
    if method == "magnitude":
        return stats.minmax_normalize(df, magnitude, exponent).filter(F.col("norm") >= threshold).select(*PIX)
    if method == "sigma_bound":
        sigma = stats.sample_std(df, sign)
        strong = join_small(df, sigma, REC).filter(finite(sign) & (F.abs(F.col(sign)) > F.col("sigma") * k * 0.5))
        body = mo.closing(mo.opening(strong.select(*PIX), "disk", 2), "disk", close)
        filled = mo.fill_holes(cut(body))
        grown = mo.fill_holes(cut(mo.dilate(filled, "disk", dilate)))
        return cc.largest_component(grown)
    raise ValueError(f"unknown cortex method {method!r}")


def patch_threshold(
    df: DataFrame, cortex: DataFrame, method: str = "sigma", *, value: float = 0.35, k: float = 1.5,
    sign: str = "vfs_smooth",
) -> tuple[DataFrame, DataFrame]:
    """(mask of strong pixels inside the cortex, threshold per recording)."""
    inside = mo.mask_and(df, cortex)
    if method == "fixed":
        thr = df.select("rec_id").distinct().withColumn("threshold", F.lit(float(value)))
        hit = F.abs(F.col(sign)) >= F.col("threshold")
    elif method == "sigma":
        s = stats.sample_std(inside, sign)
        thr = df.select("rec_id").distinct().join(s, REC, "left").select(
            "rec_id", (F.coalesce("sigma", F.lit(0.0)) * k * 0.5).alias("threshold")
        )
        hit = F.abs(F.col(sign)) > F.col("threshold")
    else:
        raise ValueError(f"unknown threshold method {method!r}")
    mask = join_small(inside, thr, REC).filter(finite(sign) & hit).select(*PIX)
    return mask, thr


# ---- patches ------------------------------------------------------------------------------------------


def pairs_on(rows: DataFrame, at: Sequence[str], patch: str) -> DataFrame:
    """(rec_id, a, b) for each place covered by two patches; few patches meet at one place."""
    met = rows.groupBy("rec_id", *at).agg(F.collect_set(patch).alias("_p")).filter(F.size("_p") > 1)
    return met.select("rec_id", F.explode("_p").alias("a"), "_p").select(
        "rec_id", "a", F.explode("_p").alias("b")
    ).filter("a < b")


def adjacent_patches(patches: DataFrame, width: int, patch: str = "patch") -> DataFrame:
    """Pairs whose dilations by width−1 cross steps overlap. Found pixel by pixel, never as all pairs.

    A width below 2 would make every pair adjacent, which says nothing; it is refused.
    """
    if width < 2:
        raise ValueError("width must be at least 2")
    wide = mo.dilate(patches, "cross", width - 1, ["rec_id", patch])
    return pairs_on(wide, ["y", "x"], patch).distinct()


def patch_overlap(projected: DataFrame, patch: str = "patch") -> DataFrame:
    """Number of visual-space cells each pair of patches shares."""
    return pairs_on(projected, ["y", "x"], patch).groupBy("rec_id", "a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def raw_patch_mask(mask: DataFrame, open_n: int, close_n: int) -> DataFrame:
    """Open, label, close every component by itself, unite."""
    lab = cc.component_roots(mo.opening(mask, "cross", open_n), 4)
    closed = mo.closing(cut(lab), "cross", close_n, ["rec_id", "root"])
    return closed.select(*PIX).distinct()


def separate_patches(raw: DataFrame, dilation: int, border_width: int = 1, codes=None) -> DataFrame:
    """Grow all patches together and cut them apart along the skeleton of the grown ring."""
    total = cut(mo.dilate(raw, "cross", dilation))
    halo = mo.mask_minus(total, raw)
    line = mo.skeletonize(halo, codes=codes)
    if border_width > 1:
        line = mo.dilate(line, "cross", border_width - 1)
    split = mo.mask_minus(total, line)
    lab = cc.component_roots(cut(split), 4).withColumnRenamed("root", "label")
    return cc.components_touching(lab, raw).select(*PIX)


def sign_patches(mask: DataFrame, signal: DataFrame, value: str) -> DataFrame:
    """Pixels of each component with `patch` (1..N in scan order) and the sign of its summed signal."""
    lab = cut(cc.label_components(mask, name="patch"))
    v = signal.select("rec_id", "y", "x", F.col(value).alias("_v"))
    s = stats.area_stats(lab.join(v, ["rec_id", "y", "x"], "left"), "_v", "patch")
    return lab.join(s.select("rec_id", "patch", "sign", "area_px"), ["rec_id", "patch"])


def calm_recordings(patches: DataFrame, noise_limit: int | None) -> tuple[DataFrame, DataFrame]:
    """(patches to work on, patches to pass through): a limit on patches per recording, if one is given."""
    if noise_limit is None:
        return patches, patches.limit(0)
    guard = cc.patch_count_guard(patches.select("rec_id", "patch").distinct(), noise_limit)
    noisy = guard.filter("noisy").select("rec_id").distinct()
    return patches.join(noisy, REC, "left_anti"), patches.join(noisy, REC, "left_semi")


def extract_patches(
    mask: DataFrame, signal: DataFrame, value: str = "vfs_smooth", *, open_n: int = 3, close_n: int = 3,
    dilation: int = 15, border_width: int = 1, min_px: int = 50, codes=None, noise_limit: int | None = None,
) -> DataFrame:
    """Patch pixels (rec_id, patch, sign, area_px, y, x …) from the thresholded mask.

    Patches without a neighbour are dropped. With `noise_limit`, recordings of more patches keep them all.
    """
    raw = cut(raw_patch_mask(mask, open_n, close_n))
    px = sign_patches(separate_patches(raw, dilation, border_width, codes), signal, value)
    px = cut(px.filter(F.col("area_px") >= min_px))
    per = px.select("rec_id", "patch").distinct()
    calm, _ = calm_recordings(px, noise_limit)
    width = max(2 * border_width, 1)
    if width >= 2:
        pairs = adjacent_patches(calm, width)
        near = pairs.select("rec_id", F.explode(F.array("a", "b")).alias("patch")).distinct()
    else:  # any other patch at all counts as a neighbour
        near = cc.patch_count_guard(per).filter("n_patches > 1").select("rec_id", "patch")
    if noise_limit is not None:
        near = near.union(cc.patch_count_guard(per, noise_limit).filter("noisy").select("rec_id", "patch"))
    return px.join(near, ["rec_id", "patch"], "left_semi")


def label_by_area(patches: DataFrame) -> DataFrame:
    """(rec_id, patch, label): rank by area, largest first, earlier patch first on a tie."""
    from pyspark.sql import Window

    per = patches.groupBy("rec_id", "patch").agg(F.count(F.lit(1)).alias("area_px"), F.max("sign").alias("sign"))
    # one row per patch; a frame bounds how many of at least the smallest size it can hold
    w = Window.partitionBy("rec_id").orderBy(F.col("area_px").desc(), "patch")
    return per.withColumn("label", F.row_number().over(w))


def assemble_labels(frame: DataFrame, patches: DataFrame) -> DataFrame:
    """Every pixel with `label` (0 outside), `sign` and `border`; where patches overlap the smaller wins."""
    ranks = label_by_area(patches).select("rec_id", "patch", "label", "sign")
    px = patches.select("rec_id", "patch", "y", "x").join(ranks, ["rec_id", "patch"])
    top = px.groupBy("rec_id", "y", "x").agg(F.max(F.struct("label", "sign")).alias("_t"))
    out = frame.select(*PIX).join(top, ["rec_id", "y", "x"], "left").select(
        *PIX, F.coalesce("_t.label", F.lit(0)).alias("label"), F.coalesce("_t.sign", F.lit(0)).alias("sign")
    )
    return stencil.label_borders(out)


# ---- maps over areas --------------------------------------------------------------------------------


def v1_center_pixel_sample(df: DataFrame, alt: str, azi: str, label: str = "label", radius: int = 10) -> DataFrame:
    """Position at the snapped centroid of the largest component of the opened area mask."""
    mask = df.filter(F.col(label) > 0).select(*PIX)
    main = cc.largest_component(cut(mo.opening(mask, "disk", radius)))
    at = stats.patch_centroid_snap(main.withColumn("_l", F.lit(1)), "_l", digits=None).select(
        "rec_id", F.col("snap_y").alias("y"), F.col("snap_x").alias("x")
    )
    return df.join(at, ["rec_id", "y", "x"]).select("rec_id", F.col(alt).alias("alt_c"), F.col(azi).alias("azi_c"))


def eccentricity(df: DataFrame, alt: str, azi: str, method: str = "visual_mean", label: str = "label", radius: int = 10) -> DataFrame:
    """Adds `eccentricity` and `polar`, 0 outside areas (and everywhere when there is no reference point)."""
    mean = stats.v1_center_visual_mean(df, alt, azi, label)
    out = join_small(df, mean, REC)
    out = out.withColumn("polar", label_roi(polar_angle(alt, azi, "alt_c", "azi_c"), label))
    if method == "visual_mean":
        e = ecc_alt(alt, azi, "alt_c", "azi_c")
    elif method == "pixel_sample":
        c = v1_center_pixel_sample(df, alt, azi, label, radius)
        out = join_small(out.drop("alt_c", "azi_c"), c, REC, "left")
        e = F.coalesce(ecc_azi(alt, azi, "alt_c", "azi_c"), F.lit(0.0))
    else:
        raise ValueError(f"unknown eccentricity method {method!r}")
    return out.withColumn("eccentricity", label_roi(e, label)).drop("alt_c", "azi_c")


def derived_maps(
    df: DataFrame, cortex: DataFrame, threshold: DataFrame, *, azi: str = "azi_deg", alt: str = "alt_deg",
    det: str = "determinant", sign: str = "vfs_smooth", label: str = "label", interval: float = 4.0,
) -> DataFrame:
    """Adds magnification, contours_azi, contours_alt and vfs_thresholded (NaN off cortex, 0 below)."""
    inside = cortex.select("rec_id", "y", "x", F.lit(True).alias("_in"))
    d = stencil.contours(df, azi, label, interval, name="contours_azi")
    d = stencil.contours(d, alt, label, interval, name="contours_alt")
    d = join_small(d, threshold, REC, "left").join(inside, ["rec_id", "y", "x"], "left")
    strong = finite(sign) & (F.abs(F.col(sign)) >= F.col("threshold"))
    kept = F.when(F.col("_in").isNull(), F.lit(float("nan"))).when(strong, F.col(sign)).otherwise(0.0)
    return d.withColumns({"magnification": magnification_factor(det, label), "vfs_thresholded": kept}).drop("_in", "threshold")


# Threshold families of the sweep
SWEEP_FIXED = [0.10, 0.15, 0.20, 0.25, 0.35]
SWEEP_SIGMA = [1.0, 1.5, 2.0, 2.5, 3.0]


def threshold_sweep(df: DataFrame, cortex: DataFrame, sign: str = "vfs_smooth", min_px: int = 100, open_n: int = 3) -> DataFrame:
    """Patch counts for fixed thresholds and for multiples of the global and in-cortex sigma."""
    inside = mo.mask_and(df, cortex).filter(finite(sign))
    v = F.when(finite(sign), F.col(sign))
    g = df.groupBy("rec_id").agg(F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("_g"))
    c = inside.groupBy("rec_id").agg(F.coalesce(F.stddev_pop(sign), F.lit(0.0)).alias("_c"))
    s = g.join(c, REC, "left").withColumn("_c", F.coalesce("_c", F.lit(0.0)))

    def cells(name, values, unit):
        return [
            F.struct(F.lit(name).alias("family"), F.lit(float(p)).alias("parameter"), (unit * p).alias("threshold"))
            for p in values
        ]

    grid = F.array(
        *cells("fixed", SWEEP_FIXED, F.lit(1.0)), *cells("global_sigma", SWEEP_SIGMA, F.col("_g")),
        *cells("cortex_sigma", SWEEP_SIGMA, F.col("_c")),
    )
    plan = s.select("rec_id", F.explode(grid).alias("_e")).select("rec_id", "_e.*")
    keys = ["rec_id", "family", "parameter"]
    hit = join_small(inside, plan, REC).filter(F.abs(F.col(sign)) >= F.col("threshold")).select(*keys, "height", "width", "y", "x")
    comps = cc.component_roots(mo.opening(hit, "cross", open_n, keys), 4, keys)
    sized = comps.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_px)
    n = sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_patches"))
    return plan.join(n, keys, "left").withColumn("n_patches", F.coalesce("n_patches", F.lit(0)))


# ---- visual space ---------------------------------------------------------------------------------------


def visual_grid(df: DataFrame, alt: str, azi: str, size: float) -> DataFrame:
    """One row per recording: origin and cell counts of the padded bounding box of its positions."""
    ok = finite(alt) & finite(azi)
    g = df.filter(ok).groupBy("rec_id").agg(
        (F.min(alt) - size).alias("alt0"), (F.max(alt) + size).alias("_a1"),
        (F.min(azi) - size).alias("azi0"), (F.max(azi) + size).alias("_z1"),
    )

    def cells(hi, lo):
        return F.greatest(F.ceil((F.col(hi) - F.col(lo)) / size), F.lit(1)).cast("int")

    return g.select("rec_id", "alt0", "azi0", cells("_a1", "alt0").alias("height"), cells("_z1", "azi0").alias("width"))


def project_visual(
    patches: DataFrame, grid: DataFrame, alt: str, azi: str, size: float, close_n: int = 0, patch: str = "patch"
) -> DataFrame:
    """Patch pixels as cells of the visual grid (rec_id, patch, height, width, y, x), closed by a cross."""
    j = patches.filter(finite(alt) & finite(azi)).select("rec_id", patch, F.col(alt).alias("_a"), F.col(azi).alias("_z"))
    j = join_small(j, grid, REC)
    cell = j.select(
        "rec_id", patch, "height", "width",
        F.floor((F.col("_a") - F.col("alt0")) / size).cast("int").alias("y"),
        F.floor((F.col("_z") - F.col("azi0")) / size).cast("int").alias("x"),
    ).filter("y >= 0 AND x >= 0 AND y < height AND x < width").distinct()
    return mo.closing(cell, "cross", close_n, ["rec_id", patch])


def visual_area(projected: DataFrame, size: float, patch: str = "patch") -> DataFrame:
    return projected.groupBy("rec_id", patch).agg((F.count(F.lit(1)) * float(size) * float(size)).alias("visual_area"))


def compare_variants(run, variants: dict[str, dict], value: str, keys: Sequence[str] = REC) -> DataFrame:
    """Run one stage (`run(**params)` → DataFrame) under several settings and compare the results."""
    return stats.variant_compare({name: run(**params) for name, params in variants.items()}, value, keys)
