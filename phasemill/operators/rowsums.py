"""Movies as image-row vectors: tasks fold frames into sums in NumPy, Spark merges the sums.

An image row stays one array from the scan to the merged sums. A task adds the frames it reads to a few
arrays per (recording, image row): all frames and resting frames, the Fourier sums of every (direction,
cycle), the mean movie per frame of the cycle, and count histograms where a median is asked for. Only these
partial sums are exchanged, still as arrays, and one pass over sorted runs adds them up. A pixel that an image
row does not have (null, or beyond the end of its array) adds nothing and is not counted. Normalisation is
affine, so that it is applied to the sums; where it is not (rectification), or where the baseline is a median,
a second scan meets the baseline as one array per image row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasemill.operators import timebase
from phasemill.operators.blocks import block_of
from phasemill.session import join_small

FRAME_BLOCK = "frame_block"  # stored column of bucketed movies: frame_idx div 64
HELD_CELLS = 1 << 21  # array elements that a task holds before it hands its sums on
KEY = ["rec_id", "y", "direction", "cycle", "k"]
NAMES = ["rec_id", "height", "width", *KEY[1:], "a", "b", "p", "q", "n", "codes", "counts"]
KEY_END = NAMES.index("a")
HISTOGRAM = -1  # `cycle` of a histogram; once merged, `a` is its median
_WINDOWS = "array<struct<direction:string,cycle:int,onset_idx:bigint,chunk:bigint>>"


# ---- schedule ------------------------------------------------------------------------------------


def scheduled(rows: DataFrame, heads: DataFrame, sweeps: DataFrame, block: int = 64) -> DataFrame:
    """Image rows with `_w`, the cycle windows that hold their frame, and `_rest`, whether it rests.

    The schedule has a row per 64 frames with the windows and resting frames in it. It is broadcast while small;
    beyond that, a movie stored in buckets of (rec_id, frame_block) is joined where it lies.
    """
    windows = timebase.number_cycles(timebase.cycle_windows(sweeps, heads))
    calm = timebase.rest_frames(heads, sweeps).select("rec_id", "frame_idx")
    last = F.col("onset_idx") + F.col("chunk") - 1
    by_block = (
        windows.select(
            "rec_id", "direction", "cycle", "onset_idx", "chunk",
            F.explode(F.sequence(block_of("onset_idx", block), block_of(last, block))).alias("_blk"),
        )
        .groupBy("rec_id", "_blk")
        .agg(F.collect_list(F.struct("direction", "cycle", "onset_idx", "chunk")).alias("_w"))
    )
    calm_block = calm.groupBy("rec_id", block_of("frame_idx", block).alias("_blk")).agg(F.collect_set("frame_idx").alias("_calm"))
    plan = by_block.join(calm_block, ["rec_id", "_blk"], "full_outer")
    placed = rows if FRAME_BLOCK in rows.columns else rows.withColumn(FRAME_BLOCK, block_of("frame_idx", block))
    j = join_small(placed, plan.withColumnRenamed("_blk", FRAME_BLOCK), ["rec_id", FRAME_BLOCK], "left")
    inside = F.filter(
        F.coalesce("_w", F.array().cast(_WINDOWS)),
        lambda w: (F.col("frame_idx") >= w["onset_idx"]) & (F.col("frame_idx") < w["onset_idx"] + w["chunk"]),
    )
    return j.withColumns({"_w": inside, "_rest": F.coalesce(F.array_contains("_calm", F.col("frame_idx")), F.lit(False))}).drop("_calm")


# ---- sums ----------------------------------------------------------------------------------------


def _schema(rows: DataFrame) -> T.StructType:
    numbers, whole = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
    kinds = [
        rows.schema["rec_id"].dataType, T.IntegerType(), T.IntegerType(), T.IntegerType(), T.StringType(), T.IntegerType(),
        T.IntegerType(), numbers, numbers, numbers, numbers, numbers, whole, whole,
    ]
    return T.StructType([T.StructField(n, k) for n, k in zip(NAMES, kinds)])


def _emit(rows: list[tuple], rec: pa.DataType) -> pa.RecordBatch:
    numbers, whole = pa.list_(pa.float64()), pa.list_(pa.int64())
    kinds = [rec, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), *[numbers] * 5, whole, whole]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], NAMES)


def _vectors(column: pa.ListArray) -> list[np.ndarray | None]:
    """The rows of a list column as views of one flat array."""
    flat = column.values.to_numpy(zero_copy_only=False)
    at, null = column.offsets.to_numpy().tolist(), column.is_null().to_pylist()
    return [None if gone else flat[x:y] for x, y, gone in zip(at, at[1:], null)]


def _pixels(column: pa.ListArray, widths: list[int]) -> list[tuple[np.ndarray | None, np.ndarray | None]]:
    """The rows of a list column, and which of their pixels there are (None: all). Short rows are filled up."""
    flat, there = column.values.to_numpy(zero_copy_only=False), column.values.is_valid().to_numpy(zero_copy_only=False)
    at, null, holes = column.offsets.to_numpy().tolist(), column.is_null().to_pylist(), column.values.null_count > 0
    out = []
    for x, y, gone, width in zip(at, at[1:], null, widths):
        v, present = flat[x:y], there[x:y] if holes and not there[x:y].all() else None
        if not gone and y - x < width:
            present = np.pad(there[x:y], (0, width - y + x))
            v = np.pad(v, (0, width - y + x))
        out.append((None, None) if gone else (v, present))
    return out


def _histogram(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (x, value) codes in order, and how often they occur."""
    if counts is None:
        return np.unique(codes, return_counts=True)
    distinct, at = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def _medians(codes: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Interpolated median per x of a histogram in order; NaN where x has no value."""
    x, value = codes >> 32, (codes & 0xFFFFFFFF) - (1 << 31)
    until = np.cumsum(counts)
    n = np.bincount(x, counts, width).astype(np.int64)
    start = np.cumsum(n) - n
    low, high = (np.minimum(np.searchsorted(until, start + k, "right"), len(value) - 1) for k in ((n - 1) // 2, n // 2))
    return np.where(n > 0, (value[low] + value[high]) / 2.0, np.nan)


class _Sums:
    """Partial sums of one task, handed on when they hold too much."""

    def __init__(self, rec: pa.DataType) -> None:
        self.rec, self.held, self.values, self.cells = rec, {}, {}, 0

    def add(self, key: tuple, shape: tuple, a: np.ndarray, b: np.ndarray | None, p, q, n) -> None:
        """`p`, `q` and `n` are numbers, or arrays where pixels are missing."""
        entry = self.held.get(key)
        if entry is None:
            self.held[key] = [shape, np.array(a, float), None if b is None else np.array(b, float), p, q, n]
            self.cells += 2 * len(a) + 3 * np.size(n)
            return
        entry[1] += a
        if b is not None:
            entry[2] = np.array(b, float) if entry[2] is None else entry[2] + b
        # not in place: a number becomes an array where pixels are missing
        entry[3], entry[4], entry[5] = entry[3] + p, entry[4] + q, entry[5] + n

    def count(self, key: tuple, shape: tuple, v: np.ndarray, present: np.ndarray | None) -> None:
        codes = (np.arange(len(v), dtype=np.int64) << 32) | (v.astype(np.int64) + (1 << 31))
        self.values.setdefault(key, (shape, []))[1].append(codes if present is None else codes[present])
        self.cells += len(v)

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = [
            (rec, *shape, y, d, cycle, k, a, b if b is not None else [], *(np.atleast_1d(c) for c in (p, q, n)), None, None)
            for (rec, y, d, cycle, k), (shape, a, b, p, q, n) in self.held.items()
        ]
        for (rec, y), (shape, parts) in self.values.items():
            codes, counts = _histogram(np.concatenate(parts))
            rows.append((rec, *shape, y, None, HISTOGRAM, *[None] * 6, codes, counts))
        for at in range(0, len(rows), 1000):
            yield _emit(rows[at : at + 1000], self.rec)
        self.held, self.values, self.cells = {}, {}, 0


def partial_sums(
    rows: DataFrame, quality: bool, histogram: str | None = None, normalization: str | None = None, rectification: str = "none"
) -> DataFrame:
    """Sums of the image rows of each task, as rows of (rec_id, y, direction, cycle, k):

    without a direction, a and b are the sums over all and over resting frames, p and q their numbers; with a
    cycle, a + ib is Σv·e and p + iq is Σe; with k (`quality`, forward directions), a is the sum of the k-th
    frames and p their number. p and q, and n, the number of frames of any sum, are arrays of one number, or of one per
    pixel where pixels are missing. `histogram` ("all" or "rest") adds counts of values. With `normalization`, the rows carry f0
    (an array) and floor, values are normalised and rectified first, and only sums with a direction are made.
    """
    rec_kind = rows.schema["rec_id"].dataType
    extra = ["f0", "floor"] if normalization else []

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            sums = sums or _Sums(batch.schema.field("rec_id").type)
            col = {n: batch.column(n).to_pylist() for n in ("rec_id", "height", "width", "y", "frame_idx", "_w", "_rest", *extra[1:])}
            pixels = _pixels(batch.column("pixels"), col["width"])
            baselines = _vectors(batch.column("f0")) if normalization else None
            for i, (v, present) in enumerate(pixels):
                if v is None:
                    continue
                one = 1.0 if present is None else present.astype(float)
                rec, y, rest, shape = col["rec_id"][i], col["y"][i], col["_rest"][i], (col["height"][i], col["width"][i])
                if normalization:
                    f0, floor = baselines[i], col["floor"][i]
                    v = v - f0
                    if normalization == "fractional":
                        v = v / np.maximum(f0, floor)
                    if rectification == "half_wave":
                        v = np.maximum(v, 0.0)
                if present is not None:
                    v = np.where(present, v, 0.0)
                if not normalization:
                    sums.add((rec, y, None, None, None), shape, v, v if rest else None, one, one * rest, one)
                    if histogram == "all" or (histogram == "rest" and rest):
                        sums.count((rec, y), shape, v, present)
                for w in col["_w"][i]:
                    k = col["frame_idx"][i] - w["onset_idx"]
                    angle = -2.0 * math.pi * k / w["chunk"]
                    c, s = math.cos(angle), math.sin(angle)
                    sums.add((rec, y, w["direction"], w["cycle"], None), shape, v * c, v * s, one * c, one * s, one)
                    if quality and w["direction"].endswith("_fwd"):
                        sums.add((rec, y, w["direction"], None, k), shape, v, None, one, 0.0, one)
                if sums.cells > HELD_CELLS:
                    yield from sums.flush()
        if sums is not None:
            yield from sums.flush()

    if not isinstance(rec_kind, (T.StringType, T.IntegralType)):
        raise TypeError("rec_id must be a string or an integer")
    used = rows.select("rec_id", "height", "width", "y", "frame_idx", "pixels", "_w", "_rest", *extra)
    return used.mapInArrow(fold, _schema(rows))


def merge_sums(partials: DataFrame) -> DataFrame:
    """One row per key: partial sums are exchanged as arrays and added along sorted runs."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, done, held = None, [], 0

        def closed(run: list) -> tuple:
            key, shape, a, b, p, q, n, codes = run
            if codes is not None:
                distinct, counts = _histogram(np.concatenate([c for c, _ in codes]), np.concatenate([n for _, n in codes]))
                a, b = _medians(distinct, counts, shape[1]), []
            return (key[0], *shape, *key[1:], a, b if b is not None else [], p, q, n, None, None)

        rec = None
        for batch in batches:
            rec = batch.schema.field("rec_id").type
            keys = list(zip(*(batch.column(n).to_pylist() for n in KEY)))
            shapes = list(zip(batch.column("height").to_pylist(), batch.column("width").to_pylist()))
            a, b, p, q, n, codes, counts = (_vectors(batch.column(c)) for c in NAMES[KEY_END:])
            for i, key in enumerate(keys):
                if run is None or key != run[0]:
                    if run is not None:
                        done.append(closed(run))
                        held += run[1][1]
                    hist = None if codes[i] is None else [(codes[i], counts[i])]
                    wide = b[i] is not None and len(b[i]) > 0
                    run = [key, shapes[i], None if hist else a[i].copy(), b[i].copy() if wide else None, p[i], q[i], n[i], hist]
                    if held > HELD_CELLS // 4:
                        yield _emit(done, rec)
                        done, held = [], 0
                elif run[7] is not None:
                    run[7].append((codes[i], counts[i]))
                else:
                    run[2] += a[i]
                    if b[i] is not None and len(b[i]):
                        run[3] = b[i].copy() if run[3] is None else run[3] + b[i]
                    run[4], run[5], run[6] = run[4] + p[i], run[5] + q[i], run[6] + n[i]
        if run is not None:
            yield _emit([*done, closed(run)], rec)

    return partials.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(merge, partials.schema)


# ---- what the sums give ----------------------------------------------------------------------------


def _of_pixel(counts: str, x: Column) -> Column:
    """The number of the pixel at x in an array that holds one for all or one for each."""
    return F.element_at(counts, F.least(x + 1, F.size(counts)).cast("int"))


def row_baseline(sums: DataFrame, baseline: str = "rest_mean") -> DataFrame:
    """(rec_id, height, width, y, f0): one array per image row. Pixels that never rest take the all-frame mean; those that
    no frame has are null."""
    base = sums.filter("direction IS NULL AND cycle IS NULL")
    mean = F.transform("a", lambda s, x: F.try_divide(s, _of_pixel("p", x)))
    if baseline == "all_mean":
        f0 = mean
    elif baseline == "rest_mean":
        rest = F.transform("b", lambda s, x: F.try_divide(s, _of_pixel("q", x)))
        f0 = F.when(F.size("b") > 0, F.zip_with(rest, mean, lambda r, m: F.coalesce(r, m))).otherwise(mean)
    elif baseline in ("all_median", "rest_median"):
        medians = sums.filter(F.col("cycle") == HISTOGRAM).select("rec_id", "y", F.col("a").alias("_m"))
        base = base.join(medians, ["rec_id", "y"], "left")
        counted = F.zip_with("_m", mean, lambda v, m: F.when(F.isnan(v), m).otherwise(v))  # NaN: no value was counted
        f0 = F.coalesce(counted, mean)
    else:
        raise ValueError(f"unknown baseline {baseline!r}")
    return base.select("rec_id", "height", "width", "y", f0.alias("f0"))


def _denominator(normalization: str):
    if normalization == "absolute":
        return lambda f0: F.lit(1.0)
    if normalization == "fractional":
        return lambda f0: F.greatest(f0, F.col("floor"))
    raise ValueError(f"unknown normalisation {normalization!r}")


def cycle_maps(sums: DataFrame, base: DataFrame | None, normalization: str = "fractional") -> DataFrame:
    """Per-cycle complex maps, one row per pixel. With `base` (rec_id, y, f0, floor) the sums are of raw values:
    Σ((v−f0)/d)·e = (Σv·e − f0·Σe)/d."""
    own = sums.filter("direction IS NOT NULL AND cycle IS NOT NULL")
    keys = ["rec_id", "direction", "cycle", "height", "width", "y"]
    if base is None:
        cells = F.arrays_zip("a", "b")
        whole = own.select(*keys, "n", F.posexplode(cells).alias("x", "_c")).filter(_of_pixel("n", F.col("x")) > 0)
        return whole.select(*keys, "x", F.col("_c.a").alias("re"), F.col("_c.b").alias("im"))
    den = _denominator(normalization)
    joined = own.join(base.select("rec_id", "y", "f0", "floor"), ["rec_id", "y"])
    cells = joined.select(*keys, "p", "q", "n", "floor", F.posexplode(F.arrays_zip("a", "b", "f0")).alias("x", "_c"))
    cells = cells.filter(_of_pixel("n", F.col("x")) > 0)
    f0, p, q = F.col("_c.f0"), _of_pixel("p", F.col("x")), _of_pixel("q", F.col("x"))
    return cells.select(
        *keys, "x", ((F.col("_c.a") - f0 * p) / den(f0)).alias("re"), ((F.col("_c.b") - f0 * q) / den(f0)).alias("im")
    )


def _noise_bins(n: int, most: int | None) -> list[int]:
    top = max(2, min((n - 1) // 2, n // 2))
    count = max(top - 4, 0)
    if most is None or count <= most:
        return list(range(5, top + 1))
    return [math.floor(i * (count / float(most))) + 5 for i in range(most)]


def _quality(trace: np.ndarray, most_bins: int | None) -> tuple[np.ndarray, np.ndarray]:
    """z-score of the first bin and spectral SNR of every column of a (frames of the cycle, pixels) array."""
    n = len(trace)
    with np.errstate(all="ignore"):
        power = np.abs(np.fft.fft(trace, axis=0)) * 2.0 / n
        z = (power[1] - power.mean(0)) / power.std(0) if n > 1 else np.full(trace.shape[1], np.nan)
        bins = np.array([1, *_noise_bins(n, most_bins)], float)
        turns = np.exp(-2j * np.pi * np.outer(bins, np.arange(n)) * (1.0 / (n - 1) if n > 1 else 0.0))
        energy = np.abs(turns @ trace) ** 2
        noise = energy[1:].sum(0) / max(len(bins) - 1, 1)
        snr = energy[0] / np.maximum(noise, 1e-20) if n >= 4 else np.zeros(trace.shape[1])
    return z, snr


def response_quality(
    sums: DataFrame, base: DataFrame | None, normalization: str = "fractional", most_bins: int | None = 20
) -> DataFrame:
    """z-score and spectral SNR per pixel and orientation, from the sums of the frames of a cycle.

    One image row of a direction, its frames by its pixels, is one step in NumPy.
    """
    frames = sums.filter("k IS NOT NULL").select("rec_id", "height", "width", "y", "direction", "k", "a", "p")
    if base is None:
        mean = frames.withColumn("v", F.transform("a", lambda s, x: F.try_divide(s, _of_pixel("p", x))))
    else:
        den = _denominator(normalization)
        joined = frames.join(base.select("rec_id", "y", "f0", "floor"), ["rec_id", "y"])
        mean = joined.withColumn("v", F.transform(
            F.arrays_zip("a", "f0"), lambda c, x: (F.try_divide(c["a"], _of_pixel("p", x)) - c["f0"]) / den(c["f0"])
        ))
    kind = T.StructType(
        [
            frames.schema["rec_id"], T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
            T.StructField("y", T.IntegerType()), T.StructField("direction", T.StringType()),
            T.StructField("zscore", T.ArrayType(T.DoubleType())), T.StructField("snr", T.ArrayType(T.DoubleType())),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, trace: list[tuple], rec: pa.DataType) -> pa.RecordBatch:
            v = np.stack([row for row, _ in trace])
            z, snr = _quality(v, most_bins)
            if any(there is not None for _, there in trace):  # pixels without some frames have a shorter cycle
                have = np.stack([np.ones(len(row), bool) if there is None else there for row, there in trace])
                z, snr = z.tolist(), snr.tolist()
                for x in np.flatnonzero(~have.all(0)):
                    one = _quality(v[have[:, x], x : x + 1], most_bins) if have[:, x].any() else ([None], [None])
                    z[x], snr[x] = one[0][0], one[1][0]
            numbers = pa.list_(pa.float64())
            kinds = [rec, pa.int32(), pa.int32(), pa.int32(), pa.string(), numbers, numbers]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*key, z, snr), kinds)], [f.name for f in kind.fields])

        last, trace, rec = None, [], None
        for batch in batches:
            rec = batch.schema.field("rec_id").type
            keys = zip(*(batch.column(n).to_pylist() for n in ("rec_id", "height", "width", "y", "direction")))
            for key, (v, there) in zip(keys, _pixels(batch.column("v"), batch.column("width").to_pylist())):
                if key != last and trace:
                    yield out(last, trace, rec)
                    trace = []
                last = key
                trace.append((v.copy(), None if there is None else there.copy()))
        if trace:
            yield out(last, trace, rec)

    ordered = mean.select("rec_id", "height", "width", "y", "direction", "k", "v").repartition("rec_id", "y", "direction")
    scored = ordered.sortWithinPartitions("rec_id", "y", "direction", "k").mapInArrow(score, kind)
    cells = scored.select(
        "rec_id", "height", "width", "y", F.substring("direction", 1, 3).alias("orientation"), F.posexplode(F.arrays_zip("zscore", "snr")).alias("x", "_c")
    )
    cells = cells.filter("_c.zscore IS NOT NULL")
    return cells.select("rec_id", "height", "width", "y", "x", F.col("_c.zscore").alias("zscore"), F.col("_c.snr").alias("snr"), "orientation")
