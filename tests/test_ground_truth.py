"""Closed-form recordings with a known answer."""

import math

import pytest
from pyspark.sql import functions as F

from phasemill.operators import maps, project, stats
from phasemill.plans.analyze import Settings, analyze, analyze_maps

TWO_PI = 2 * math.pi


def pixels(spark, h, w):
    return (
        spark.range(h * w)
        .select((F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
        .select(F.lit("r1").alias("rec_id"), F.lit(h).alias("height"), F.lit(w).alias("width"), "y", "x")
    )


def recordings(spark, azi=120.0, alt=100.0, k=0):
    return spark.createDataFrame(
        [("r1", azi, alt, 0.0, 0.0, k, 20.0)],
        "rec_id string, azi_range double, alt_range double, offset_azi double, offset_alt double, rotation_k int, um_per_pixel double",
    )


def mirror_pair(spark, n=64):
    """Azimuth rises to the middle column and falls again, altitude is linear: two areas of opposite sign."""
    half = n / 2
    azi = 1.6 * (1 - F.abs(F.col("x") - (half - 0.5)) / half)
    alt = 1.4 * (2 * F.col("y") / (n - 1) - 1)
    p = pixels(spark, n, n).withColumn("azi", azi).withColumn("alt", alt)
    lag = math.pi / 4
    rows = []
    for o in ("azi", "alt"):
        for d, sg in (("fwd", 1), ("rev", -1)):
            ph = F.col(o) * sg + lag
            rows.append(F.struct(F.lit(f"{o}_{d}").alias("direction"), F.cos(ph).alias("re"), F.sin(ph).alias("im")))
    truth = p.select("rec_id", "y", "x", "azi", "alt")
    m = p.select("rec_id", "height", "width", "y", "x", F.explode(F.array(*rows)).alias("_e")).select(
        "rec_id", "height", "width", "y", "x", "_e.*"
    )
    return m, truth


def test_mirror_pair_phase_and_sign(spark):
    m, truth = mirror_pair(spark)
    r = maps.retinotopy(m)
    j = r.join(truth, ["rec_id", "y", "x"]).filter("y BETWEEN 4 AND 59 AND x BETWEEN 4 AND 59 AND abs(x - 31.5) > 4")
    got = j.select(
        F.max(F.abs(F.col("azi_phase") - F.col("azi"))).alias("ea"), F.max(F.abs(F.col("alt_phase") - F.col("alt"))).alias("el"),
        F.avg(F.when(F.abs("vfs") > 0.5, 1.0).otherwise(0.0)).alias("strong"),
        F.count_distinct(F.when(F.col("x") < 32, F.signum("vfs"))).alias("left"),
        F.sum(F.when(F.col("x") < 32, F.signum("vfs"))).alias("sl"), F.sum(F.when(F.col("x") >= 32, F.signum("vfs"))).alias("sr"),
    ).first()
    assert got.ea < 2e-2 and got.el < 2e-2
    assert got.strong > 0.99 and got.left == 1
    assert got.sl * got.sr < 0


def test_two_areas_of_opposite_sign(spark):
    m, _ = mirror_pair(spark)
    s = Settings(
        sign_sigma_um=20.0, cortex="none", threshold="fixed", threshold_params={"value": 0.5},
        extraction={"open_n": 1, "close_n": 1, "dilation": 3, "min_px": 50}, refinement_params={"close_n": 3, "min_px": 50},
    )
    a = analyze_maps(recordings(spark), m, s)
    sizes = {(r.label, r.sign): r["count"] for r in a.pixel_maps.filter("label > 0").groupBy("label", "sign").count().collect()}
    assert len(sizes) == 2
    assert {s for _, s in sizes} == {-1, 1}
    assert all(n > 1000 for n in sizes.values())


def movie(spark, lag_deg, h=8, w=10, cycles=2, n=40, azi_range=140.0, alt_range=90.0):
    """Rows of camera counts encoding position by phase, with rest before and between sweeps."""
    lead, gap = 8, 8
    span = n + gap
    azi = (F.col("x") / (w - 1) - 0.5) * 80.0
    alt = (F.col("y") / (h - 1) - 0.5) * 50.0
    total = lead + 4 * cycles * span
    f = spark.range(total).select(F.col("id").alias("frame_idx"), (F.col("id") * 0.1).alias("ts_sec"))
    sw = F.floor((F.col("frame_idx") - lead) / span).cast("int")
    k = F.col("frame_idx") - lead - sw * span
    d = F.floor(sw / cycles)
    px = pixels(spark, h, w).withColumn("azi", azi).withColumn("alt", alt)
    j = f.withColumn("k", k).withColumn("d", d).crossJoin(px)  # test data only
    pos = F.when(F.col("d") < 2, F.col("azi") * (TWO_PI / azi_range)).otherwise(F.col("alt") * (TWO_PI / alt_range))
    sg = F.when(F.col("d") % 2 == 0, 1.0).otherwise(-1.0)
    wave = F.cos(F.col("k") * (TWO_PI / n) + sg * pos + math.radians(lag_deg))
    on = (F.col("k") >= 0) & (F.col("k") < n)
    v = F.round((F.when(on, wave * 0.02).otherwise(0.0) + 1.0) * 20000).cast("int")
    cell = F.struct("x", v.alias("p"))
    rows = j.groupBy("rec_id", "frame_idx", "ts_sec", "y", "height", "width").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    rows = rows.withColumn("pixels", F.col("c.p")).drop("c")
    names = ["LR", "RL", "TB", "BT"]
    sweeps = spark.createDataFrame(
        [
            ("r1", i, names[i // cycles], 0.1 * (lead + i * span), 0.1 * (lead + i * span) + 0.1 * n - 0.05)
            for i in range(4 * cycles)
        ],
        "rec_id string, sweep_idx int, label string, start_sec double, end_sec double",
    )
    truth = px.select("rec_id", "y", "x", F.col("azi").alias("t_azi"), F.col("alt").alias("t_alt"))
    return rows, sweeps, truth


@pytest.mark.parametrize("lag,flips", [(85.0, False), (-120.0, True)])
def test_movie_recovery(spark, lag, flips):
    rows, sweeps, truth = movie(spark, lag)
    m, _ = project.complex_maps(rows, sweeps)
    r = maps.retinotopy(m, azi_range=140.0, alt_range=90.0).join(truth, ["rec_id", "y", "x"])
    r = r.withColumn("off", F.pmod(F.col("azi_deg") - F.col("t_azi"), F.lit(140.0)))
    med = stats.recovery_error(r.withColumn("z", F.lit(70.0 if flips else 0.0)).withColumn(
        "off", F.when((F.col("off") > 105) & (F.lit(not flips)), F.col("off") - 140).otherwise(F.col("off"))), "off", "z").first()
    assert med.median_err < (2.0 if flips else 0.5)
    if not flips:
        alt = stats.recovery_error(r, "alt_deg", "t_alt").first()
        assert alt.median_err < 0.05 and alt.max_err < 0.2


def test_linear_and_general_paths_agree(spark):
    rows, sweeps, _ = movie(spark, 40.0, h=3, w=4)
    _, a = project.complex_maps(rows, sweeps)
    f0 = project.movie_baseline(rows, sweeps, "rest_mean")
    smp = project.normalize_samples(project.attach_baseline(project.movie_samples(rows, sweeps), f0, project.dff_floor(f0)))
    b = project.bin1_projection(smp)
    j = a.join(b.withColumnsRenamed({"re": "r2", "im": "i2"}), ["rec_id", "direction", "cycle", "height", "width", "y", "x"])
    got = j.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("re") - F.col("r2")) + F.abs(F.col("im") - F.col("i2"))).alias("e")).first()
    assert got.n == 8 * 12 and got.e < 1e-9


def test_whole_analysis_runs_with_rotation(spark):
    rows, sweeps, _ = movie(spark, 85.0)
    s = Settings(
        cortex="reliability", cortex_params={"threshold": 0.5}, threshold="fixed", threshold_params={"value": 0.3},
        position_sigma=0.0, sign_sigma_um=0.0, extraction={"open_n": 0, "close_n": 0, "dilation": 1, "min_px": 2}, refinement="none",
    )
    a = analyze(recordings(spark, 140.0, 90.0, 1), rows, sweeps, s)
    m = a.pixel_maps
    assert m.select("height", "width").distinct().collect() == [(10, 8)]
    assert m.count() == 80
    for leaf in ("eccentricity", "polar", "magnification", "contours_azi", "vfs_thresholded", "border", "cortex", "rel_azi_fwd"):
        assert leaf in m.columns
