"""Clocks, frame order, and the joins between schedules and frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.functions.columns import classify_direction, safe_div
from phasemill.operators import quantiles
from phasemill.operators.blocks import (
    BLOCK_ROWS,
    asof_nearest,
    block_of,
    neighbour_rows,
    running_sum,
)
from phasemill.session import join_small

DAY_US = 86_400_000_000
REC = ["rec_id"]


# ---- time base -------------------------------------------------------------------------------


def unify_timebase(df: DataFrame, frames: DataFrame, us: str, name: str, sys_us: str = "sys_us") -> DataFrame:
    """Seconds since the first camera frame's system stamp of the same recording."""
    t0 = frames.groupBy("rec_id").agg(F.min_by(sys_us, "frame_idx").alias("_t0"))
    return join_small(df, t0, REC).withColumn(name, (F.col(us) - F.col("_t0")) / 1e6).drop("_t0")


def unwrap_midnight(df: DataFrame, hw: str = "hw_us", name: str = "hw_unwrapped") -> DataFrame:
    """Add a day after every fall-back larger than half a day."""
    back = neighbour_rows(
        df, REC, "frame_idx",
        {"_wrap": lambda w: F.when(F.col(hw) + DAY_US // 2 < F.lag(hw).over(w), 1).otherwise(0)}, before=1,
    )
    back = back.withColumn("_b", block_of("frame_idx", BLOCK_ROWS))
    out = running_sum(back, REC, "_b", ["frame_idx"], "_wrap", "_days")
    return out.withColumn(name, F.col(hw) + F.col("_days") * DAY_US).drop("_wrap", "_b", "_days")


def clock_drift(df: DataFrame) -> DataFrame:
    """Least-squares drift of (system − unwrapped hardware) over elapsed system time, in µs."""
    u = unwrap_midnight(df)
    ends = u.groupBy("rec_id").agg(
        F.min_by("sys_us", "frame_idx").alias("_s0"), F.max_by("sys_us", "frame_idx").alias("_s1"),
        # offsets are taken relative to the first one, which keeps the sums small
        F.min_by(F.col("sys_us") - F.col("hw_unwrapped"), "frame_idx").alias("_o0"),
    )
    j = join_small(u, ends, REC).select(
        "rec_id", "_s0", "_s1", "_o0", (F.col("sys_us") - F.col("_s0")).cast("double").alias("t"),
        (F.col("sys_us") - F.col("hw_unwrapped") - F.col("_o0")).cast("double").alias("o"),
    )
    fit = j.groupBy("rec_id").agg(
        F.avg("o").alias("ob"), F.avg("t").alias("tb"),
        F.covar_pop("t", "o").alias("sxy"), F.var_pop("t").alias("sxx"),
        F.max(F.col("_s1") - F.col("_s0")).alias("dur"), F.max("_o0").alias("o0"),
    )
    slope = F.when(F.col("sxx") > 0, F.try_divide("sxy", "sxx")).otherwise(0.0)
    fit = fit.withColumn("slope", slope)
    icpt = F.col("ob") - F.col("slope") * F.col("tb")
    start = F.round(icpt + F.col("o0")).cast("bigint")
    end = F.round(icpt + F.col("slope") * F.col("dur") + F.col("o0")).cast("bigint")
    return fit.select(
        "rec_id", start.alias("start_us"), end.alias("end_us"), (end - start).alias("drift_us")
    )


def sweep_plan(conditions: DataFrame, reps: str | int, order: str, seed: int = 0) -> DataFrame:
    """Trial order. `conditions` has rec_id, cond_idx, condition (and a repetition column if named).

    sequential: condition-major; interleaved: repetition-major; randomized: a seeded shuffle.
    """
    n = F.col(reps) if isinstance(reps, str) else F.lit(reps)
    ncond = Window.partitionBy("rec_id")
    trials = conditions.withColumn("_nc", F.count(F.lit(1)).over(ncond)).withColumn(
        "rep", F.explode(F.sequence(F.lit(0), n - 1))
    )
    if order == "sequential":
        return trials.withColumn("trial", (F.col("cond_idx") * n + F.col("rep")).cast("int")).drop("_nc")
    if order == "interleaved":
        return trials.withColumn("trial", (F.col("rep") * F.col("_nc") + F.col("cond_idx")).cast("int")).drop("_nc")
    if order == "randomized":
        key = F.sha2(F.concat_ws("|", F.lit(str(seed)), "rec_id", "cond_idx", "rep"), 256)
        w = Window.partitionBy("rec_id").orderBy(key, "cond_idx", "rep")  # a plan: bounded by the protocol
        return trials.withColumn("trial", (F.row_number().over(w) - 1).cast("int")).drop("_nc")
    raise ValueError(f"unknown order {order!r}")


# ---- schedules and frames ----------------------------------------------------------------------


def with_direction(sweeps: DataFrame) -> DataFrame:
    return sweeps.withColumn("direction", classify_direction("label"))


FRAMES_PER_BUCKET = 4096


def bucket_lengths(frames: DataFrame, time: str, per_bucket: int = FRAMES_PER_BUCKET) -> DataFrame:
    """(rec_id, _bucket, _first, _last): time buckets of about `per_bucket` frames of the recording itself."""
    span = frames.groupBy("rec_id").agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.count(F.lit(1)).alias("_n"))
    step = F.try_divide((F.col("_last") - F.col("_first")).cast("double"), (F.col("_n") - 1).cast("double"))
    return span.select("rec_id", F.coalesce(F.nullif(step, F.lit(0.0)) * per_bucket, F.lit(1.0)).alias("_bucket"), "_first", "_last")


def nearest_frame(
    sweeps: DataFrame, frames: DataFrame, bucket_sec: float | None = None, name: str = "onset_idx"
) -> DataFrame:
    """As-of nearest frame of each sweep onset; a tie goes to the earlier frame.

    Both sides meet in time buckets of `bucket_sec`; by default a bucket holds some thousand frames of its recording.
    """
    if bucket_sec is not None:
        return asof_nearest(sweeps, frames, REC, "start_sec", "ts_sec", "frame_idx", bucket_sec, name)
    lengths = bucket_lengths(frames, "ts_sec").select("rec_id", "_bucket")
    timed = frames.select("rec_id", "ts_sec", "frame_idx").join(lengths, REC)
    known = sweeps.join(lengths, REC, "left").withColumn("_bucket", F.coalesce("_bucket", F.lit(1.0)))
    return asof_nearest(known, timed, REC, "start_sec", "ts_sec", "frame_idx", F.col("_bucket"), name).drop("_bucket")


def frame_summary(frames: DataFrame) -> DataFrame:
    """Per recording: frame count, first and last time, mean frame duration."""
    s = frames.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("ts_sec").alias("ts0"), F.max("ts_sec").alias("ts1")
    )
    return s.withColumn(
        "frame_dur", F.try_divide(F.col("ts1") - F.col("ts0"), (F.col("n_frames") - 1).cast("double"))
    )


def cycle_windows(sweeps: DataFrame, frames: DataFrame, bucket_sec: float | None = None) -> DataFrame:
    """Chunk length and onset frame of every sweep of a known direction, and whether it is usable."""
    known = with_direction(sweeps).filter("direction IS NOT NULL")
    dur = known.groupBy("rec_id", "direction").agg(
        F.avg(F.col("end_sec") - F.col("start_sec")).alias("chunk_dur")
    )
    onset = nearest_frame(known, frames, bucket_sec)
    j = onset.join(dur, ["rec_id", "direction"]).join(frame_summary(frames).filter("n_frames >= 2"), REC)
    chunk = F.ceil(safe_div("chunk_dur", "frame_dur")).cast("bigint")
    kept = (
        (F.col("start_sec") >= F.col("ts0"))
        & (F.col("start_sec") + F.col("chunk_dur") <= F.col("ts1"))
        & (F.col("onset_idx") + F.col("chunk") <= F.col("n_frames"))
    )
    return j.withColumn("chunk", chunk).withColumn("kept", kept).select(
        "rec_id", "sweep_idx", "direction", "start_sec", "end_sec", "onset_idx", "chunk", "frame_dur", "kept"
    )


def number_cycles(windows: DataFrame) -> DataFrame:
    """Usable windows with a 0-based cycle number per direction, in schedule order."""
    w = Window.partitionBy("rec_id", "direction").orderBy("sweep_idx")
    return windows.filter("kept").withColumn("cycle", (F.row_number().over(w) - 1).cast("int"))


def attach_cycle(frames: DataFrame, windows: DataFrame, block: int = 64) -> DataFrame:
    """Frames inside each window with `direction`, `cycle`, `k`; a frame may serve several cycles.

    The interval join is an equi-join on (rec_id, frame block): each window is copied only to the
    blocks it touches, so neither side meets a whole recording. There is one window per block and cycle;
    while that list is small it goes to the frames, which then stay where they are.
    """
    last = F.col("onset_idx") + F.col("chunk") - 1
    spans = windows.filter("chunk > 0").select(
        "rec_id", "direction", "cycle", "onset_idx", "chunk",
        F.explode(F.sequence(block_of("onset_idx", block), block_of(last, block))).alias("_blk"),
    )
    return (
        join_small(frames.withColumn("_blk", block_of("frame_idx", block)), spans, ["rec_id", "_blk"])
        .filter("frame_idx >= onset_idx AND frame_idx < onset_idx + chunk")
        .withColumn("k", (F.col("frame_idx") - F.col("onset_idx")).cast("int"))
        .drop("_blk", "onset_idx")
    )


def busy_blocks(sweeps: DataFrame, lengths: DataFrame) -> DataFrame:
    """Closed sweep intervals, copied to the time buckets of their recording that they touch.

    What lies outside the recorded time is cut off first: an interval is copied at most as often as its recording has buckets.
    """
    s = sweeps.filter("start_sec <= end_sec").select("rec_id", "start_sec", "end_sec").join(lengths, REC)
    s = s.filter("end_sec >= _first AND start_sec <= _last")
    first, last = F.greatest("start_sec", "_first"), F.least("end_sec", "_last")
    cover = F.sequence(block_of(first, F.col("_bucket")), block_of(last, F.col("_bucket")))
    return s.select("rec_id", "start_sec", "end_sec", F.explode(cover).alias("_b"))


def rest_frames(frames: DataFrame, sweeps: DataFrame, bucket_sec: float | None = None) -> DataFrame:
    """Frames in no closed sweep interval (anti interval join through buckets of some thousand frames)."""
    lengths = bucket_lengths(frames, "ts_sec")
    if bucket_sec is not None:
        lengths = lengths.withColumn("_bucket", F.lit(float(bucket_sec)))
    timed = frames.join(lengths.select("rec_id", "_bucket"), REC)
    f = timed.withColumn("_b", block_of("ts_sec", F.col("_bucket"))).alias("f")
    s = busy_blocks(sweeps, lengths).alias("s")
    hit = (
        (F.col("f.rec_id") == F.col("s.rec_id")) & (F.col("f._b") == F.col("s._b"))
        & (F.col("f.ts_sec") >= F.col("s.start_sec")) & (F.col("f.ts_sec") <= F.col("s.end_sec"))
    )
    return f.join(s, hit, "left_anti").drop("_b", "_bucket")


def condition_lookup(stim: DataFrame, conditions: DataFrame) -> DataFrame:
    return join_small(stim, conditions, ["rec_id", "condition_idx"], "left")


# ---- frame order -------------------------------------------------------------------------------


def frame_deltas(
    df: DataFrame, ts: str = "hw_us", name: str = "delta", keys: Sequence[str] = REC,
    extra: dict | None = None,
) -> DataFrame:
    """Adds the difference to the previous frame (null on the first)."""
    cols = {name: lambda w: F.col(ts) - F.lag(ts).over(w)}
    cols.update(extra or {})
    return neighbour_rows(df, list(keys), "frame_idx", cols, before=1)


def with_sequence_gap(df: DataFrame) -> DataFrame:
    """Adds `delta` and `gap` = step of the hardware counter (null on the first frame)."""
    return frame_deltas(df, extra={"gap": lambda w: F.col("seq") - F.lag("seq").over(w)})


def sequence_gaps(df: DataFrame) -> DataFrame:
    """Frames whose counter does not follow the previous one."""
    return with_sequence_gap(df).filter("gap <> 1").select("rec_id", "frame_idx", "gap")


def sequence_drops(df: DataFrame) -> DataFrame:
    """Lost frames: Σ(gap−1) over forward gaps, and the count of non-consecutive steps."""
    g = with_sequence_gap(df)
    return g.groupBy("rec_id").agg(
        F.coalesce(F.sum(F.when(F.col("gap") > 1, F.col("gap") - 1)), F.lit(0)).alias("n_dropped"),
        F.count(F.when(F.col("gap") != 1, 1)).alias("n_breaks"),
    )


def expected_delta_us(fps: Column | float) -> Column:
    return F.floor(F.lit(1e6) / (fps if isinstance(fps, Column) else F.lit(float(fps)))).cast("bigint")


def dropped_frames(df: DataFrame, fps: float, threshold: float, warmup: int, ts: str = "hw_us") -> DataFrame:
    """Frames at or after the warm-up whose delta exceeds expected × threshold."""
    d = frame_deltas(df, ts)
    late = F.col("delta") > expected_delta_us(fps) * F.lit(float(threshold))
    return d.filter((F.col("frame_idx") >= warmup) & late).select("rec_id", "frame_idx", "delta")


def rolling_fps(df: DataFrame, n: int, ts: str = "hw_us", name: str = "fps") -> DataFrame:
    """1e6 over the mean of the last `n` deltas; 0 with fewer than two deltas or a mean ≤ 0."""
    out = neighbour_rows(
        df, REC, "frame_idx",
        {
            "_first": lambda w: F.first(ts).over(w.rowsBetween(-n, 0)),
            "_m": lambda w: (F.count(F.lit(1)).over(w.rowsBetween(-n, 0)) - 1),
        },
        before=n,
    )
    span = (F.col(ts) - F.col("_first")).cast("double")  # the deltas telescope
    ok = (F.col("frame_idx") >= 2) & (span > 0)
    return out.withColumn(name, F.when(ok, F.try_divide(F.lit(1e6) * F.col("_m"), span)).otherwise(0.0)).drop(
        "_first", "_m"
    )


def timing_anomalies(df: DataFrame, factor: float, warmup: int, ts: str = "hw_us") -> DataFrame:
    """Deltas beyond median × factor, counted from delta number `warmup`."""
    d = frame_deltas(df, ts).filter("delta IS NOT NULL")
    med = quantiles.median(d, REC, "delta", "median_us").select("rec_id", "median_us")
    j = join_small(d, med, REC)
    late = (F.col("frame_idx") - 1 >= warmup) & (F.col("delta") > F.col("median_us") * F.lit(float(factor)))
    return j.filter(late).select("rec_id", "frame_idx", "delta", "median_us")
