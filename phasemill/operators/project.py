"""From movies to per-direction complex maps: baselines, bin-1 sums, cycle averages, response quality.

`samples` are rows (rec_id, direction, cycle, k, y, x, v) with the frame size and the number of frames
per cycle in `chunk`: the form of small tables and of checks. Whole movies take the path of image-row vectors
in `rowsums`, which explodes no sample and exchanges partial sums only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.functions.columns import TWO_PI, col, finite, normalize, rectify, safe_div
from phasemill.operators import quantiles, rowsums, timebase
from phasemill.operators.rowsums import FRAME_BLOCK  # noqa: F401  (the writers of movies use it)
from phasemill.session import BROADCAST_BYTES, cut, join_small

REC = ["rec_id"]
PIX = ["rec_id", "height", "width", "y", "x"]
MAP = ["rec_id", "direction", "height", "width", "y", "x"]


# ---- movies ------------------------------------------------------------------------------------


def pixels_long(rows: DataFrame) -> DataFrame:
    """One row per pixel of each image row; a null is a pixel that the frame does not have."""
    rest = [c for c in rows.columns if c != "pixels"]
    return rows.select(*rest, F.posexplode("pixels").alias("x", "v")).filter("v IS NOT NULL").withColumn("v", F.col("v").cast("double"))


def frame_headers(rows: DataFrame) -> DataFrame:
    """One row per frame, read from its first image row."""
    return rows.filter("y = 0").select("rec_id", "frame_idx", "ts_sec")


def frame_intensity(rows: DataFrame) -> DataFrame:
    """Mean pixel value per frame; 0 for an empty frame."""
    there = F.array_compact("pixels")
    tot = F.aggregate(there, F.lit(0).cast("bigint"), lambda a, p: a + p)
    g = rows.groupBy("rec_id", "frame_idx").agg(F.sum(tot).alias("_s"), F.sum(F.size(there)).alias("_n"))
    return g.select(
        "rec_id", "frame_idx", F.coalesce(F.try_divide(F.col("_s").cast("double"), "_n"), F.lit(0.0)).alias("mean_intensity")
    )


# ---- baselines -----------------------------------------------------------------------------------


def baseline_mean(samples: DataFrame, value: str = "v") -> DataFrame:
    return samples.groupBy(*PIX).agg(F.avg(value).alias("f0"))


def baseline_median(samples: DataFrame, value: str = "v") -> DataFrame:
    """Exact interpolated median per pixel. Camera counts take at most 65,536 values, which bounds the state."""
    return samples.groupBy(*PIX).agg(F.percentile(value, 0.5).alias("f0"))


def baseline_rest(samples: DataFrame, in_rest: str, aggregate: str = "mean", value: str = "v") -> DataFrame:
    """Baseline over rest frames; the all-frame mean where a recording has none."""
    rest = F.when(F.col(in_rest), F.col(value))
    over_rest = F.avg(rest) if aggregate == "mean" else F.percentile(rest, 0.5)
    return samples.groupBy(*PIX).agg(F.coalesce(over_rest, F.avg(value)).alias("f0"))


def dff_floor(f0: DataFrame, value: str = "f0", keys: Sequence[str] = REC) -> DataFrame:
    """Denominator floor per recording: half the upper median of the finite baseline, at least 1."""
    recs = f0.select(*keys).distinct()
    med = quantiles.upper_median(f0.filter(finite(value)), keys, value, "_m")
    return recs.join(med, list(keys), "left").select(
        *keys, F.greatest(F.coalesce(F.col("_m") * 0.5, F.lit(1.0)), F.lit(1.0)).alias("floor")
    )


def attach_baseline(samples: DataFrame, f0: DataFrame, floor: DataFrame) -> DataFrame:
    """Join the baseline (per pixel) and its floor (per recording) to the samples."""
    base = join_small(f0, floor, REC).select("rec_id", "y", "x", "f0", "floor")
    return samples.join(base, ["rec_id", "y", "x"])


def normalize_samples(
    samples: DataFrame, method: str = "fractional", rectification: str = "none", value: str = "v"
) -> DataFrame:
    return samples.withColumn(value, rectify(normalize(value, "f0", "floor", method), rectification))


# ---- bin-1 sums ------------------------------------------------------------------------------------


def kernel(k: str | Column, chunk: str | Column | int, harmonic: int = 1) -> tuple[Column, Column]:
    """cos and sin of −2πk/chunk."""
    n = F.lit(chunk) if isinstance(chunk, int) else col(chunk)
    a = F.lit(-TWO_PI * harmonic) * col(k) / n
    return F.cos(a), F.sin(a)


def bin1_projection(samples: DataFrame, chunk: str | int = "chunk", value: str = "v") -> DataFrame:
    """Unnormalised first Fourier bin per (direction, cycle, pixel)."""
    c, s = kernel("k", chunk)
    return samples.groupBy("rec_id", "direction", "cycle", "height", "width", "y", "x").agg(
        F.sum(F.col(value) * c).alias("re"), F.sum(F.col(value) * s).alias("im")
    )


def cycle_phase(cycle_maps: DataFrame) -> DataFrame:
    """Global phase of each cycle."""
    g = cycle_maps.groupBy("rec_id", "direction", "cycle").agg(F.sum("re").alias("_r"), F.sum("im").alias("_i"))
    return g.select("rec_id", "direction", "cycle", F.atan2("_i", "_r").alias("phi"))


def cycle_average(cycle_maps: DataFrame, method: str = "simple") -> DataFrame:
    """Combine the cycles of each direction into one complex map."""
    if method == "simple":
        turned = cycle_maps
    elif method == "phase_locked":
        phi = cycle_phase(cycle_maps)
        mean = phi.groupBy("rec_id", "direction").agg(
            F.atan2(F.sum(F.sin("phi")), F.sum(F.cos("phi"))).alias("_bar")
        )
        a = phi.join(mean, ["rec_id", "direction"]).select(
            "rec_id", "direction", "cycle", (F.col("_bar") - F.col("phi")).alias("_a")
        )
        c, s = F.cos("_a"), F.sin("_a")
        turned = cycle_maps.join(a, ["rec_id", "direction", "cycle"]).withColumns(
            {"re": F.col("re") * c - F.col("im") * s, "im": F.col("re") * s + F.col("im") * c}
        )
    else:
        raise ValueError(f"unknown cycle average {method!r}")
    return turned.groupBy(*MAP).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


def reliability(cycle_maps: DataFrame) -> DataFrame:
    """|ΣZ| / max(Σ|Z|, 1e-20); null for a whole recording if any of the four directions has fewer than two cycles."""
    z = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    per = cycle_maps.groupBy(*MAP).agg(
        F.sum("re").alias("_r"), F.sum("im").alias("_i"), F.sum(z).alias("_a"),
        F.count(F.lit(1)).alias("n_cycles"),
    )
    # one row per recording; a recording without one of the four directions has no reliability at all
    gate = per.groupBy("rec_id").agg(
        F.when(F.size(F.collect_set("direction")) == 4, F.min("n_cycles")).otherwise(0).alias("_min")
    )
    coherent = F.sqrt(F.col("_r") * F.col("_r") + F.col("_i") * F.col("_i")) / F.greatest(F.col("_a"), F.lit(1e-20))
    return join_small(per, gate, REC).select(*MAP, F.when(F.col("_min") >= 2, coherent).alias("reliability"))


# ---- response quality --------------------------------------------------------------------------------


def average_movie(samples: DataFrame, value: str = "v") -> DataFrame:
    """Mean over cycles at each frame of the cycle."""
    return samples.groupBy(*MAP, "k").agg(F.avg(value).alias("v"))


def _trace(movie: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per pixel with its ordered one-cycle trace (bounded by the frames of a cycle)."""
    pairs = F.array_sort(F.collect_list(F.struct("k", "v")))
    return movie.groupBy(*MAP, *extra).agg(pairs.alias("_t")).withColumn("_t", F.col("_t.v"))


def _dft(bin_index: Column, per_sample: Column) -> tuple[Column, Column]:
    """Real and imaginary sums of the trace `_t` at angle −2π·bin·t·per_sample."""

    def total(fn):
        terms = F.zip_with(
            F.col("_t"), F.sequence(F.lit(0), F.size("_t") - 1),
            lambda v, t: v * fn(F.lit(-TWO_PI) * bin_index * t * per_sample),
        )
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)

    return total(F.cos), total(F.sin)


def power_spectrum(movie: DataFrame) -> DataFrame:
    """|DFT_b|·2/n for every bin b of each pixel's averaged trace."""
    t = _trace(movie)
    b = t.select(*MAP, "_t", F.explode(F.sequence(F.lit(0), F.size("_t") - 1)).alias("bin"))
    re, im = _dft(F.col("bin"), F.lit(1.0) / F.size("_t"))
    return b.select(*MAP, "bin", F.size("_t").alias("n"), re.alias("_r"), im.alias("_i")).select(
        *MAP, "bin", (F.sqrt(F.col("_r") * F.col("_r") + F.col("_i") * F.col("_i")) * 2.0 / F.col("n")).alias("power")
    )


def _spectrum_stats(spectrum: DataFrame, bin: int) -> DataFrame:
    return spectrum.groupBy(*MAP).agg(
        F.max(F.when(F.col("bin") == bin, F.col("power"))).alias("_p"),
        F.avg("power").alias("_m"), F.stddev_pop("power").alias("_s"),
    )


def power_zscore(spectrum: DataFrame, bin: int = 1) -> DataFrame:
    """(power[bin] − mean) / population std over all bins; ±inf or NaN where the spectrum is flat."""
    return _spectrum_stats(spectrum, bin).select(
        *MAP, safe_div(F.col("_p") - F.col("_m"), "_s").alias("zscore")
    )


def power_mask(spectrum: DataFrame, bin: int = 1, sigma: float = 3.0) -> DataFrame:
    return _spectrum_stats(spectrum, bin).select(
        *MAP, (F.col("_p") >= F.col("_m") + F.col("_s") * sigma).alias("responsive")
    )


def noise_bins(n: Column, most: int | None = 20) -> Column:
    """Bins 5..max_bin, thinned evenly to `most` when there are more (None keeps all); the period is (n−1) steps."""
    # nyquist / stimulus frequency is (n−1)/2, so its floor never exceeds n/2
    top = F.greatest(F.lit(2), F.least(F.floor((n - 1) / 2), F.floor(n / 2))).cast("int")
    count = F.greatest(top - 4, F.lit(0))
    allbins = F.when(count > 0, F.sequence(F.lit(5), F.greatest(top, F.lit(5)))).otherwise(F.array().cast("array<int>"))
    if most is None:
        return allbins
    pick = F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (F.floor(i * (count / float(most))) + 5).cast("int")
    )
    return F.when(count > most, pick).otherwise(allbins)


def spectral_snr(movie: DataFrame, most_bins: int | None = 20) -> DataFrame:
    """Power at the stimulus frequency over mean power of the noise bins; 0 for traces under four frames."""
    t = _trace(movie).withColumn("_n", F.size("_t"))
    step = F.when(F.col("_n") > 1, F.lit(1.0) / (F.col("_n") - 1)).otherwise(0.0)

    def power(b):
        re, im = _dft(b, step)
        return re * re + im * im

    bins = noise_bins(F.col("_n"), most_bins)
    t = t.withColumn("_b", bins).withColumn("_sig", power(F.lit(1)))
    t = t.withColumn("_noise", F.transform("_b", power))
    # with no noise bin at all the reference quantity is an all-zero kernel, hence zero power
    noise = F.aggregate("_noise", F.lit(0.0), lambda a, p: a + p) / F.greatest(F.size("_b"), F.lit(1))
    snr = F.when(F.col("_n") < 4, F.lit(0.0)).otherwise(F.col("_sig") / F.greatest(noise, F.lit(1e-20)))
    return t.select(*MAP, snr.alias("snr"))


def responsiveness(samples: DataFrame) -> DataFrame:
    """z-score and spectral SNR once per orientation, on the forward direction."""
    movie = average_movie(samples.filter(F.col("direction").endswith("_fwd")))
    z = power_zscore(power_spectrum(movie), 1)
    return z.join(spectral_snr(movie), MAP).withColumn(
        "orientation", F.substring("direction", 1, 3)
    ).drop("direction")


# ---- whole movie --------------------------------------------------------------------------------------


def one_scan_sums(rows: DataFrame, sweeps: DataFrame, quality: bool = False, histogram: str | None = None) -> DataFrame:
    """Everything an affine analysis needs from the movie, in one scan and one exchange of partial sums."""
    return rowsums.merge_sums(rowsums.partial_sums(rowsums.scheduled(rows, frame_headers(rows), sweeps), quality, histogram))


def normalized_sums(
    rows: DataFrame, sweeps: DataFrame, base: DataFrame, normalization: str, rectification: str, quality: bool = False
) -> DataFrame:
    """Sums of normalised and rectified values: a scan in which the baseline, one array per image row, comes to the movie.

    It is broadcast while its measured size allows; beyond that the image rows are exchanged, as arrays.
    """
    placed = rowsums.scheduled(rows, frame_headers(rows), sweeps)
    widest = base.agg(F.max("width")).first()[0] or 0
    limit = BROADCAST_BYTES * 1024 // (8 * widest + 1024)  # join_small takes 1,024 bytes for an array
    joined = join_small(placed, base.select("rec_id", "y", "f0", "floor"), ["rec_id", "y"], limit=limit)
    return rowsums.merge_sums(rowsums.partial_sums(joined, quality, None, normalization, rectification))


def with_floor(base: DataFrame) -> DataFrame:
    """Image-row baselines with the denominator floor of their recording."""
    pixels = base.select("rec_id", F.explode("f0").alias("f0"))
    return join_small(base, dff_floor(pixels), REC)


def movie_baseline(rows: DataFrame, sweeps: DataFrame, method: str = "rest_mean") -> DataFrame:
    """Baseline per pixel: all_mean, all_median, rest_mean or rest_median."""
    base = rowsums.row_baseline(_baseline_sums(rows, sweeps, method), method)
    return base.select("rec_id", "height", "width", "y", F.posexplode("f0").alias("x", "f0")).filter("f0 IS NOT NULL")


def _baseline_sums(rows: DataFrame, sweeps: DataFrame, method: str, quality: bool = False) -> DataFrame:
    histogram = method.removesuffix("_median") if method.endswith("_median") else None
    return cut(one_scan_sums(rows, sweeps, quality, histogram))


def movie_maps(
    rows: DataFrame, sweeps: DataFrame, baseline: str | DataFrame = "rest_mean", normalization: str = "fractional",
    rectification: str = "none", quality: bool = True, most_bins: int | None = 20,
) -> tuple[DataFrame, DataFrame | None]:
    """(per-cycle complex maps, z-score and SNR per orientation) of whole movies.

    `baseline` is a name or a table of one array `f0` per (rec_id, height, width, y).

    Without rectification, one scan: the written sums give the baseline, its floor, the maps and the quality. With it, a
    second scan normalises image rows before they are summed. No sample is exploded in either.
    """
    affine = rectification == "none"
    if isinstance(baseline, str):
        sums = _baseline_sums(rows, sweeps, baseline, quality and affine)
        base = cut(with_floor(rowsums.row_baseline(sums, baseline)))
    else:
        sums = cut(one_scan_sums(rows, sweeps, quality)) if affine else None
        base = cut(with_floor(baseline))
    if not affine:
        sums, given = cut(normalized_sums(rows, sweeps, base, normalization, rectification, quality)), None
    else:
        given = base
    scored = rowsums.response_quality(sums, given, normalization, most_bins) if quality else None
    return rowsums.cycle_maps(sums, given, normalization), scored


def movie_samples(rows: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Samples of all usable cycles with `chunk`: the exploded form, for checks and small movies."""
    windows = timebase.number_cycles(timebase.cycle_windows(sweeps, frame_headers(rows)))
    return pixels_long(
        timebase.attach_cycle(rows, windows.select("rec_id", "direction", "cycle", "onset_idx", "chunk"))
    )


def movie_responsiveness(
    rows: DataFrame, sweeps: DataFrame, baseline: str = "rest_mean", normalization: str = "fractional",
    rectification: str = "none", most_bins: int | None = 20,
) -> DataFrame:
    """z-score and spectral SNR per orientation of whole movies."""
    return movie_maps(rows, sweeps, baseline, normalization, rectification, True, most_bins)[1]


def complex_maps(
    rows: DataFrame, sweeps: DataFrame, baseline: str = "rest_mean", normalization: str = "fractional",
    rectification: str = "none", average: str = "simple",
) -> tuple[DataFrame, DataFrame]:
    """(direction maps, per-cycle maps) of whole movies."""
    cycles, _ = movie_maps(rows, sweeps, baseline, normalization, rectification, quality=False)
    return cycle_average(cycles, average), cycles
