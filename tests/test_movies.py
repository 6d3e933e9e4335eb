"""Whole movies by image-row vectors, against the exploded samples."""

import pytest
from pyspark.sql import functions as F

from phasemill.operators import project, rowsums

ROWS = "rec_id string, height int, width int, frame_idx bigint, ts_sec double, y int, pixels array<int>"
SWEEPS = "rec_id string, sweep_idx int, label string, start_sec double, end_sec double"


def movies(spark, frames=120):
    """Two recordings of unequal size; the second one never rests."""
    import random

    r = random.Random(2)
    rows, sweeps = [], []
    for rec, h, w in (("a", 3, 4), ("b", 2, 5)):
        for f in range(frames):
            rows += [(rec, h, w, f, f * 0.1, y, [r.choice([700, 900, 1000, 1013, 1100]) + x for x in range(w)]) for y in range(h)]
        for i in range(8):
            end = 1.05 if rec == "a" else 1.5
            sweeps.append((rec, i, ("LR", "RL", "TB", "BT")[i // 2], i * 1.5, i * 1.5 + end))
        if rec == "b":
            sweeps.append((rec, 8, "none", 0.0, frames * 0.1))
    return spark.createDataFrame(rows, ROWS).repartition(6), spark.createDataFrame(sweeps, SWEEPS)


def sampled(rows, sweeps, baseline, normalization, rectification):
    px = project.pixels_long(rows)
    if baseline == "all_median":
        f0 = project.baseline_median(px)
    else:
        calm = project.timebase.rest_frames(project.frame_headers(rows), sweeps).select("rec_id", "frame_idx", F.lit(True).alias("rest"))
        flagged = project.pixels_long(rows.join(calm, ["rec_id", "frame_idx"], "left").withColumn("rest", F.coalesce("rest", F.lit(False))))
        f0 = project.baseline_mean(px) if baseline == "all_mean" else project.baseline_rest(flagged, "rest", baseline.removeprefix("rest_"))
    s = project.attach_baseline(project.movie_samples(rows, sweeps), f0, project.dff_floor(f0))
    return f0, project.normalize_samples(s, normalization, rectification)


def gap(a, b, keys, values):
    j = a.join(b.select(*keys, *[F.col(v).alias(f"_{v}") for v in values]), keys, "full")
    return j.agg(F.count(F.lit(1)), F.count(values[0]), F.count(f"_{values[0]}"), *[F.max(F.abs(F.col(v) - F.col(f"_{v}")) / F.greatest(F.lit(1.0), F.abs(F.col(v)))) for v in values]).first()


@pytest.mark.parametrize(
    "baseline,normalization,rectification",
    [("rest_mean", "fractional", "none"), ("all_median", "absolute", "none"), ("rest_median", "fractional", "half_wave"), ("all_mean", "absolute", "half_wave")],
)
def test_row_vectors_equal_samples(spark, monkeypatch, baseline, normalization, rectification):
    monkeypatch.setattr(rowsums, "HELD_CELLS", 40)  # many partial sums
    rows, sweeps = movies(spark)
    f0, samples = sampled(rows, sweeps, baseline, normalization, rectification)
    n, left, right, worst = gap(project.movie_baseline(rows, sweeps, baseline), f0, ["rec_id", "y", "x"], ["f0"])
    assert n == left == right == 22 and worst < 1e-9
    cycles, quality = project.movie_maps(rows, sweeps, baseline, normalization, rectification)
    n, left, right, *worst = gap(cycles, project.bin1_projection(samples), ["rec_id", "direction", "cycle", "y", "x"], ["re", "im"])
    assert n == left == right == 12 * 8 + 10 * 7 and max(worst) < 1e-6  # the last sweep of b ends behind the movie
    n, left, right, *worst = gap(quality, project.responsiveness(samples), ["rec_id", "orientation", "y", "x"], ["zscore", "snr"])
    assert n == left == right == 22 * 2 and max(worst) < 1e-6


def test_image_rows_with_a_large_baseline_are_exchanged_whole(spark, monkeypatch):
    rows, sweeps = movies(spark)
    want = {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in project.movie_maps(rows, sweeps, rectification="half_wave")[0].collect()}
    monkeypatch.setattr(project, "BROADCAST_BYTES", -1 << 20)
    got = {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in project.movie_maps(rows, sweeps, rectification="half_wave")[0].collect()}
    assert got == want


def test_noise_bins_are_those_of_the_sample_path(spark):
    for n in range(1, 80):
        for most in (20, 3, None):
            want = spark.range(1).select(project.noise_bins(F.lit(n), most)).first()[0] if n % 13 == 0 else None
            assert want is None or rowsums._noise_bins(n, most) == want


def test_empty_movie(spark):
    rows, sweeps = movies(spark)
    cycles, quality = project.movie_maps(rows.limit(0), sweeps)
    assert cycles.count() == 0 and quality.count() == 0


def test_missing_pixels_are_not_counted(spark, monkeypatch):
    import random

    monkeypatch.setattr(rowsums, "HELD_CELLS", 40)
    rows, sweeps = movies(spark)
    r, holed = random.Random(4), []
    for row in rows.collect():
        pixels = [None if r.random() < 0.1 else p for p in row["pixels"]]
        if row["rec_id"] == "b" and row["y"] == 1:  # one pixel is in no frame, one only in those of two directions
            pixels = [pixels[0], None, pixels[2], pixels[3] if row["frame_idx"] < 60 else None][: 4 if row["frame_idx"] < 60 else 3]
        holed.append((*row[:-1], pixels))
    rows = spark.createDataFrame(holed, ROWS).repartition(6)
    for baseline, rectification in (("rest_mean", "none"), ("all_median", "none"), ("rest_median", "half_wave")):
        f0, samples = sampled(rows, sweeps, baseline, "fractional", rectification)
        n, left, right, worst = gap(project.movie_baseline(rows, sweeps, baseline), f0, ["rec_id", "y", "x"], ["f0"])
        assert n == left == right == 20 and worst < 1e-9
        cycles, quality = project.movie_maps(rows, sweeps, baseline, "fractional", rectification)
        n, left, right, *worst = gap(cycles, project.bin1_projection(samples), ["rec_id", "direction", "cycle", "y", "x"], ["re", "im"])
        assert n == left == right and max(worst) < 1e-6
        n, left, right, *worst = gap(quality, project.responsiveness(samples), ["rec_id", "orientation", "y", "x"], ["zscore", "snr"])
        assert n == left == right and max(worst) < 1e-6
