"""Per-map and per-area statistics. All are partial aggregations per key; none collects a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.functions.columns import finite, safe_div
from phasemill.operators import quantiles
from phasemill.operators.stencil import frame_stats

REC = ["rec_id"]


def _when_finite(value: str, mask: str | None = None) -> Column:
    ok = finite(value)
    if mask:
        ok = ok & F.col(mask)
    return F.when(ok, F.col(value))


def sample_std(df: DataFrame, value: str, mask: str | None = None, keys: Sequence[str] = REC, name: str = "sigma") -> DataFrame:
    """Sample standard deviation over finite values (in the mask); 0 with fewer than two."""
    v = _when_finite(value, mask)
    return df.groupBy(*keys).agg(F.when(F.count(v) < 2, F.lit(0.0)).otherwise(F.stddev_samp(v)).alias(name))


def minmax_normalize(df: DataFrame, value: str, exponent: float, keys: Sequence[str] = REC, name: str = "norm") -> DataFrame:
    """(m^e − min)/(max − min) over finite values; null where it cannot pass any threshold."""
    p = df.withColumn("_p", F.when(finite(value), F.pow(F.col(value), F.lit(float(exponent)))))
    j = frame_stats(p, {"_lo": F.min("_p"), "_hi": F.max("_p")}, keys)
    span = F.col("_hi") - F.col("_lo")
    return j.withColumn(name, F.when(span > 0, F.try_divide(F.col("_p") - F.col("_lo"), span))).drop("_p", "_lo", "_hi")


def circular_stats(df: DataFrame, phase: str, weight: str, keys: Sequence[str] = REC) -> DataFrame:
    """Weighted circular mean and standard deviation in degrees; (0, 0) without a positive weight."""
    w = F.when(finite(weight) & (F.col(weight) > 0), F.col(weight))
    g = df.groupBy(*keys).agg(
        F.sum(w * F.cos(phase)).alias("_c"), F.sum(w * F.sin(phase)).alias("_s"), F.sum(w).alias("_w")
    )
    std = F.sqrt(F.log(resultant(F.col("_c"), F.col("_s"), F.col("_w"))) * -2.0)
    return g.select(
        *keys, F.coalesce(F.degrees(F.atan2("_s", "_c")), F.lit(0.0)).alias("circ_mean"),
        F.coalesce(F.degrees(std), F.lit(0.0)).alias("circ_std"),
    )


def resultant(c: Column, s: Column, w: Column) -> Column:
    """Resultant length clamped to [1e-12, 1]."""
    r = F.try_divide(F.sqrt(c * c + s * s), w)
    return F.least(F.greatest(r, F.lit(1e-12)), F.lit(1.0))


def _det3(rows) -> Column:
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = [[F.col(v) for v in row] for row in rows]
    return a1 * (b2 * c3 - b3 * c2) - a2 * (b1 * c3 - b3 * c1) + a3 * (b1 * c2 - b2 * c1)


def phase_plane_fit(df: DataFrame, re: str, im: str, keys: Sequence[str] = REC, guarded: bool = True) -> DataFrame:
    """Is the phase a smooth plane? Amplitude-weighted fit a + b·x + c·y to the residual phase.

    Uses pixels above 0.2 of the largest amplitude, with the mean phasor subtracted. The 3x3 normal
    equations are sums, so the fit is two aggregations. Returns spread, r2, phase_range, n_px.
    Guarded, fewer than 8 pixels give zeros, and a determinant below 1e-9 gives zero r2 and phase_range;
    otherwise every map is solved, and r2 and phase_range are NaN where its pixels determine no plane.
    """
    keys = list(keys)
    amp = F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im))
    j = frame_stats(df.withColumn("_a", amp), {"_top": F.max("_a")}, keys)
    s = frame_stats(j.filter(F.col("_a") > F.col("_top") * 0.2), {"_gr": F.avg(re), "_gi": F.avg(im)}, keys)
    s = s.withColumns(
        {
            "_r": F.atan2(F.col(im) - F.col("_gi"), F.col(re) - F.col("_gr")),
            "_x": F.col("x").cast("double"), "_y": F.col("y").cast("double"),
        }
    )

    def m(*cols):
        term = F.col("_a")
        for c in cols:
            term = term * F.col(c)
        return F.sum(term)

    fit = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("height").alias("h"), F.max("width").alias("w"),
        F.sum(re).alias("zr"), F.sum(im).alias("zi"), m().alias("s1"), m("_x").alias("sx"), m("_y").alias("sy"),
        m("_x", "_x").alias("sxx"), m("_x", "_y").alias("sxy"), m("_y", "_y").alias("syy"),
        m("_r").alias("sr"), m("_x", "_r").alias("sxr"), m("_y", "_r").alias("syr"),
    )
    fit = fit.withColumns(
        {
            "d": _det3([["s1", "sx", "sy"], ["sx", "sxx", "sxy"], ["sy", "sxy", "syy"]]),
            "da": _det3([["sr", "sx", "sy"], ["sxr", "sxx", "sxy"], ["syr", "sxy", "syy"]]),
            "db": _det3([["s1", "sr", "sy"], ["sx", "sxr", "sxy"], ["sy", "syr", "syy"]]),
            "dc": _det3([["s1", "sx", "sr"], ["sx", "sxx", "sxr"], ["sy", "sxy", "syr"]]),
        }
    )
    if guarded:
        solvable = (F.col("n") >= 8) & (F.abs("d") >= 1e-9)
        fit = fit.withColumns({k: F.when(solvable, F.try_divide(f"d{k}", "d")) for k in ("a", "b", "c")})
    else:
        fit = fit.withColumns({k: safe_div(f"d{k}", "d") for k in ("a", "b", "c")})
    second = s.join(fit.select(*keys, "a", "b", "c", (F.col("sr") / F.col("s1")).alias("rbar")), keys)
    off = F.col("_r") - (F.col("a") + F.col("b") * F.col("_x") + F.col("c") * F.col("_y"))
    dev = F.col("_r") - F.col("rbar")
    err = second.groupBy(*keys).agg(
        F.sum(F.col("_a") * off * off).alias("ssr"), F.sum(F.col("_a") * dev * dev).alias("sst")
    )
    few = (F.col("n") < 8) & F.lit(guarded)
    spread = F.sqrt(F.log(resultant(F.col("zr"), F.col("zi"), F.col("s1"))) * -2.0)
    part = F.try_divide("ssr", F.when(F.col("sst") > 0, F.col("sst"))) if guarded else safe_div("ssr", "sst")
    r2 = F.greatest(F.lit(1.0) - part, F.lit(0.0))
    reach = F.abs("b") * (F.col("w") - 1.0) + F.abs("c") * (F.col("h") - 1.0)
    return fit.join(err, keys).select(
        *keys, F.when(few, 0.0).otherwise(spread).alias("spread"),
        F.coalesce(r2, F.lit(0.0)).alias("r2"), F.coalesce(reach, F.lit(0.0)).alias("phase_range"),
        F.col("n").alias("n_px"),
    )


# ---- areas --------------------------------------------------------------------------------------------


def area_stats(df: DataFrame, signal: str, label: str = "label", keys: Sequence[str] = REC) -> DataFrame:
    """Pixels, sign and centroid per area; an area without a finite signal pixel is dropped."""
    v = _when_finite(signal)
    g = df.filter(F.col(label) > 0).groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("area_px"), F.count(v).alias("_nf"), F.sum(v).alias("_s"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"),
    )
    sign = F.when(F.col("_s") >= 0, 1).otherwise(-1)
    return g.filter("_nf > 0").select(*keys, label, "area_px", sign.alias("sign"), "cy", "cx")


def patch_center_visual(df: DataFrame, alt: str, azi: str, label: str = "label", keys: Sequence[str] = REC) -> DataFrame:
    """Mean altitude over altitude ≠ 0 and mean azimuth over azimuth ≠ 0, independently."""
    g = df.filter(F.col(label) > 0).groupBy(*keys, label)
    return g.agg(
        F.coalesce(F.avg(F.when(F.col(alt) != 0, F.col(alt))), F.lit(0.0)).alias("center_alt"),
        F.coalesce(F.avg(F.when(F.col(azi) != 0, F.col(azi))), F.lit(0.0)).alias("center_azi"),
    )


def sigma_area(df: DataFrame, det: str, label: str = "label", keys: Sequence[str] = REC) -> DataFrame:
    """Sum of the determinant over each area; one NaN anywhere in the frame makes it NaN."""
    bad = df.groupBy(*keys).agg(F.max(F.isnan(det)).alias("_bad"))
    g = df.filter(F.col(label) > 0).groupBy(*keys, label).agg(F.sum(F.nanvl(det, F.lit(0.0))).alias("_s"))
    return g.join(bad, list(keys)).select(
        *keys, label, F.when(F.col("_bad"), F.lit(float("nan"))).otherwise(F.col("_s")).alias("sigma_area")
    )


def patch_centroid_snap(
    df: DataFrame, label: str = "label", keys: Sequence[str] = REC, ties: str = "row", digits: int | None = 9
) -> DataFrame:
    """Rounded centroid of each area, or the nearest area pixel when the centroid lies off the area.

    Distances that agree in `digits` digits tie, whatever the last bits of the centroid are; None compares all bits.
    """
    a = df.filter(F.col(label) > 0)
    c = a.groupBy(*keys, label).agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
    j = a.join(c, [*keys, label])
    # floor(v + 0.5): halves go up, and coordinates are never negative
    ry, rx = F.floor(F.col("_cy") + 0.5), F.floor(F.col("_cx") + 0.5)
    on = (F.col("y") == ry) & (F.col("x") == rx)
    dist = (F.col("y") - F.col("_cy")) * (F.col("y") - F.col("_cy")) + (F.col("x") - F.col("_cx")) * (F.col("x") - F.col("_cx"))
    dist = dist if digits is None else F.round(dist, digits)
    order = ("y", "x") if ties == "row" else ("x", "y")
    best = F.min_by(
        F.struct("y", "x"), F.struct((~on).alias("off"), F.when(on, 0.0).otherwise(dist).alias("d"), *order)
    )
    return j.groupBy(*keys, label).agg(best.alias("_b")).select(
        *keys, label, F.col("_b.y").alias("snap_y"), F.col("_b.x").alias("snap_x")
    )


def largest_label(df: DataFrame, label: str = "label", keys: Sequence[str] = REC) -> DataFrame:
    """The label with most pixels per key; equal sizes take the highest label."""
    sizes = df.filter(F.col(label) > 0).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.groupBy(*keys).agg(F.max(F.struct("_n", label)).alias("_m")).select(
        *keys, F.col(f"_m.{label}").alias(label)
    )


def v1_center_visual_mean(df: DataFrame, alt: str, azi: str, label: str = "label", keys: Sequence[str] = REC) -> DataFrame:
    """Mean position over the largest area, (0, 0) for a recording without areas."""
    recs = df.select(*keys).distinct()
    big = largest_label(df, label, keys)
    m = df.join(big, [*keys, label], "left_semi").groupBy(*keys).agg(F.avg(alt).alias("_a"), F.avg(azi).alias("_z"))
    return recs.join(m, list(keys), "left").select(
        *keys, F.coalesce("_a", F.lit(0.0)).alias("alt_c"), F.coalesce("_z", F.lit(0.0)).alias("azi_c")
    )


# ---- display, comparison, summaries --------------------------------------------------------------------


def display_range(df: DataFrame, value: str, kind: str = "minmax", keys: Sequence[str] = REC) -> DataFrame:
    """Colour limits: finite min/max, or the 2nd..98th percentile (nearest rank) of finite non-zero values."""
    recs = df.select(*keys).distinct()
    if kind == "minmax":
        v = df.filter(finite(value)).groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    elif kind == "percentile":
        ok = df.filter(finite(value) & (F.col(value) != 0))
        v = quantiles.nearest_rank(ok, keys, value, {"_lo": 0.02, "_hi": 0.98})
    else:
        raise ValueError(f"unknown range {kind!r}")
    j = recs.join(v, list(keys), "left")
    lo, hi = F.coalesce("_lo", F.lit(0.0)), F.coalesce("_hi", F.lit(1.0))
    return j.select(
        *keys, lo.alias("display_min"), F.when(F.abs(hi - lo) < 1e-12, lo + 1.0).otherwise(hi).alias("display_max")
    )


def bins_mean(df: DataFrame, value: str, edges: Sequence[float], keys: Sequence[str] = REC, name: str = "binned") -> DataFrame:
    """Replace values strictly inside a bin by the bin's mean; values on an edge or outside stay."""
    bin_no = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        bin_no = F.when((F.col(value) > edges[i]) & (F.col(value) < edges[i + 1]), i).otherwise(bin_no)
    d = df.withColumn("_bin", bin_no)
    m = d.filter("_bin IS NOT NULL").groupBy(*keys, "_bin").agg(F.avg(value).alias("_m"))
    return d.join(m, [*keys, "_bin"], "left").withColumn(name, F.coalesce("_m", value)).drop("_bin", "_m")


def leaf_summary(df: DataFrame, leaves: Sequence[str], keys: Sequence[str] = REC) -> DataFrame:
    """Finite min and max of each named leaf: one row per key and leaf."""
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("leaf"), F.col(n).cast("double").alias("v")) for n in leaves])
        ).alias("_l"),
    ).select(*keys, "_l.leaf", "_l.v")
    ok = F.when(F.col("v").isNotNull() & ~F.isnan("v"), F.col("v"))
    return long.groupBy(*keys, "leaf").agg(
        F.min(ok).alias("min"), F.max(ok).alias("max"), F.count(F.when(ok != 0, 1)).alias("n_nonzero")
    )


def schedule_summary(sweeps: DataFrame) -> DataFrame:
    """Sweeps in all, distinct known directions, fewest cycles of any known direction."""
    from phasemill.operators.timebase import with_direction

    per = with_direction(sweeps).groupBy("rec_id", "direction").agg(F.count(F.lit(1)).alias("_n"))
    known = F.col("direction").isNotNull()
    return per.groupBy("rec_id").agg(
        F.sum("_n").alias("n_sweeps"), F.count("direction").alias("n_directions"),
        F.coalesce(F.min(F.when(known, F.col("_n"))), F.lit(0)).alias("min_cycles"),
    )


def timeline_summary(cam: DataFrame, stim: DataFrame, sweeps: DataFrame) -> DataFrame:
    """One row per sweep with the counts and first/last seconds of both frame streams."""

    def span(df, p):
        return df.groupBy("rec_id").agg(
            F.count(F.lit(1)).alias(f"{p}_n"), F.min("ts_sec").alias(f"{p}_first"), F.max("ts_sec").alias(f"{p}_last")
        )

    both = span(cam, "cam").join(span(stim, "stim"), REC, "full_outer")
    return both.join(sweeps.select("rec_id", "sweep_idx", "label", "start_sec", "end_sec"), REC, "left")


def variant_compare(variants: dict[str, DataFrame], value: str, keys: Sequence[str] = REC) -> DataFrame:
    """Mean, exact median and max of one quantity under several methods, with per-variant totals.

    Totals over all recordings come as rows with a null key.
    """
    long = None
    for name, df in variants.items():
        one = df.select(*keys, F.lit(name).alias("variant"), F.col(value).cast("double").alias("v")).filter(finite("v"))
        long = one if long is None else long.unionByName(one)
    # the grouping sets ((keys, variant), (variant)) as one rollup with the variant outermost
    both = long.rollup("variant", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("v").alias("max"), F.grouping_id().alias("_g")
    )
    whole = (1 << len(keys)) - 1
    both = both.filter(F.col("_g").isin(0, whole))
    by_rec = quantiles.median(long, [*keys, "variant"], "v").drop("n")
    total = quantiles.median(long, ["variant"], "v").select("variant", F.col("median").alias("_tm"))
    out = both.join(by_rec, [*keys, "variant"], "left").join(total, ["variant"], "left")
    return out.select(
        *keys, "variant", "n", "mean", F.when(F.col("_g") == 0, F.col("median")).otherwise(F.col("_tm")).alias("median"), "max"
    )


def recovery_error(df: DataFrame, estimate: str, truth: str, keys: Sequence[str] = REC, sign: tuple[str, str] | None = None) -> DataFrame:
    """Median and max absolute error, and the share of pixels with the right sign."""
    e = df.withColumn("_e", F.abs(F.col(estimate) - F.col(truth)))
    med = quantiles.median(e, keys, "_e", "median_err")
    ok = F.lit(None).cast("double")
    if sign:
        ok = F.avg(F.when(F.signum(F.col(sign[0])) == F.signum(F.col(sign[1])), 1.0).otherwise(0.0))
    mx = e.groupBy(*keys).agg(F.max("_e").alias("max_err"), ok.alias("sign_accuracy"))
    return med.join(mx, list(keys))
