"""Acquisition quality from frame headers, in batch. One row per recording unless stated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.functions.columns import safe_div
from phasemill.operators import quantiles
from phasemill.operators.blocks import BLOCK_ROWS, block_of, index_rows, neighbour_rows, running_sum
from phasemill.operators.timebase import bucket_lengths, dropped_frames, frame_deltas, sequence_drops, with_sequence_gap
from phasemill.session import join_small

REC = ["rec_id"]
# Loss that ends an acquisition
CATASTROPHIC_GAP = 60
CATASTROPHIC_FRACTION = 0.05


def _note(cond, text):
    return F.when(cond, text)


def capture_quality(
    frames: DataFrame, anomaly_factor: float = 1.5, warmup: int = 5, max_jitter_fraction: float = 0.05
) -> DataFrame:
    """Counts, rates, jitter, drops and anomalies with a verdict and the reasons for a failure."""
    d = with_sequence_gap(frames)
    med = quantiles.median(d.filter("delta IS NOT NULL"), REC, "delta", "median_us").select("rec_id", "median_us")
    j = join_small(d, med, REC, "left")
    late = (F.col("frame_idx") - 1 >= warmup) & (F.col("delta") > F.col("median_us") * float(anomaly_factor))
    g = j.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        (F.max_by("hw_us", "frame_idx") - F.min_by("hw_us", "frame_idx")).alias("_span"),
        F.max("median_us").alias("median_period_us"),
        F.coalesce(F.stddev_pop("delta"), F.lit(0.0)).alias("jitter_us"),
        F.coalesce(F.sum(F.when(F.col("gap") > 1, F.col("gap") - 1)), F.lit(0)).alias("sequence_drops"),
        F.count(F.when(late, 1)).alias("timing_anomalies"),
        F.coalesce(F.max("delta"), F.lit(0)).alias("max_delta_us"),
    )
    sec = F.col("_span") / 1e6
    few = F.col("n_frames") < 2
    med0 = F.coalesce("median_period_us", F.lit(0.0))
    g = g.withColumns(
        {
            "duration_sec": sec,
            "mean_fps": F.when(sec > 0, F.try_divide(F.col("n_frames") - 1, sec)).otherwise(0.0),
            "median_period_us": med0,
            "jitter_fraction": F.when(med0 > 0, F.try_divide(F.col("jitter_us"), med0)).otherwise(0.0),
        }
    ).drop("_span")
    reasons = F.array_compact(
        F.array(
            _note(few, F.lit("too few frames")),
            _note(~few & (F.col("sequence_drops") > 0), F.format_string("%d dropped", "sequence_drops")),
            _note(~few & (F.col("timing_anomalies") > 0), F.format_string("%d late", "timing_anomalies")),
            _note(~few & (F.col("jitter_fraction") > max_jitter_fraction), F.lit("jitter")),
        )
    )
    return g.withColumn("failures", reasons).withColumn("passed", F.size("failures") == 0)


def timing_characterization(cam: DataFrame, stim: DataFrame, params: DataFrame) -> DataFrame:
    """How the camera and display clocks beat against each other.

    `cam` and `stim` hold (rec_id, delta) in µs; `params` holds n_trials, inter_trial_sec, session_sec and
    clock_uncertainty_us per recording.
    """

    def rates(df, p):
        m = F.avg("delta")
        return df.filter("delta IS NOT NULL").groupBy("rec_id").agg(
            (m / 1e6).alias(f"t_{p}"), safe_div(F.lit(1e6), m).alias(f"f_{p}"),
            (F.stddev_pop("delta") / 1e6).alias(f"{p}_jitter"), F.count("delta").alias(f"{p}_n"),
        )

    j = rates(cam, "cam").join(rates(stim, "stim"), REC).join(params, REC)
    diff = F.abs(F.col("f_cam") - F.col("f_stim"))
    beat = F.when(diff > 1e-10, F.try_divide(F.lit(1.0), diff)).otherwise(F.lit(float("inf")))
    j = j.withColumns(
        {
            "rate_ratio": safe_div("f_stim", "f_cam"),
            "beat_sec": beat,
            "phase_increment": safe_div(F.pmod("t_stim", "t_cam"), "t_cam"),
            "onset_sec": F.sqrt(
                F.pow(F.col("clock_uncertainty_us") / 1e6, F.lit(2.0)) + F.pow("stim_jitter", F.lit(2.0))
                + F.pow("cam_jitter", F.lit(2.0))
            ),
        }
    )
    regime = (
        F.when(F.col("beat_sec") < F.col("inter_trial_sec"), "uniform")
        .when(F.col("beat_sec") > F.col("session_sec"), "systematic").otherwise("partial")
    )
    j = j.withColumns(
        {
            "regime": regime,
            "phase_coverage": F.least(safe_div("session_sec", "beat_sec"), F.lit(1.0)),
            "onset_fraction": safe_div("onset_sec", "t_cam"),
        }
    )
    j = j.withColumn("phase_samples", F.least(F.col("n_trials") * F.col("phase_coverage"), F.col("n_trials").cast("double")))
    warn = F.array_compact(
        F.array(
            _note(F.col("regime") == "systematic", F.lit("systematic timing")),
            _note((F.col("regime") == "partial") & (F.col("phase_coverage") < 0.5), F.lit("low phase coverage")),
            _note(F.col("onset_fraction") > 0.5, F.lit("high onset uncertainty")),
        )
    )
    return j.withColumn("warnings", warn)


def clock_offset_uncertainty(frames: DataFrame) -> DataFrame:
    """Population spread of system − hardware time."""
    off = (F.col("sys_us") - F.col("hw_us")).cast("double")
    return frames.groupBy("rec_id").agg(F.stddev_pop(off).alias("uncertainty_us"))


def quality_summary(
    cam: DataFrame, stim: DataFrame, recordings: DataFrame, intensity: DataFrame | None = None,
    fps: float = 60.0, threshold: float = 1.5, warmup: int = 10, stim_ts: str = "hw_us",
) -> DataFrame:
    """Totals per recording; `recordings` carries `complete` and `validatable` flags."""
    c = sequence_drops(cam).select("rec_id", F.col("n_breaks").alias("camera_drops"))
    s = dropped_frames(stim, fps, threshold, warmup, stim_ts).groupBy("rec_id").agg(F.count(F.lit(1)).alias("stimulus_drops"))
    out = recordings.select("rec_id", "complete", "validatable").join(c, REC, "left").join(s, REC, "left")
    if intensity is not None:
        m = intensity.groupBy("rec_id").agg(
            F.min("mean_intensity").alias("min_intensity"), F.max("mean_intensity").alias("max_intensity")
        )
        out = out.join(m, REC, "left")
    return out.withColumns(
        {
            "camera_drops": F.coalesce("camera_drops", F.lit(0)),
            "stimulus_drops": F.coalesce("stimulus_drops", F.lit(0)),
            "display_scanout": F.when(F.col("validatable"), "physical").otherwise("remote_virtual"),
        }
    )


def sweep_intervals(events: DataFrame, bucket_us: float | None = None) -> DataFrame:
    """Realised intervals from started/completed events (rec_id, ts_us, kind, ord).

    A start is closed by the very next event of the two kinds if that is a completion. Events are ordered in
    buckets of `bucket_us`; by default a bucket holds some thousand events of its recording.
    """
    e = events.filter(F.col("kind").isin("started", "completed"))
    if bucket_us is None:
        e = e.join(bucket_lengths(e, "ts_us").select("rec_id", "_bucket"), REC)
        e = e.withColumn("_b", block_of("ts_us", F.col("_bucket"))).drop("_bucket")
    else:
        e = e.withColumn("_b", block_of("ts_us", bucket_us))
    e = index_rows(e, REC, "_b", ["ts_us", "ord"], "frame_idx").drop("_b")
    e = neighbour_rows(
        e, REC, "frame_idx",
        {"_k": lambda w: F.lead("kind").over(w), "end_us": lambda w: F.lead("ts_us").over(w)}, after=1,
    )
    return e.filter("kind = 'started' AND _k = 'completed'").select(
        "rec_id", F.col("ts_us").alias("start_us"), "end_us", (F.col("end_us") - F.col("ts_us")).alias("duration_us")
    )


def drop_monitor(frames: DataFrame, warmup: int = 30) -> DataFrame:
    """Per frame: lost frames just before it, the running loss, and whether the run should have ended."""
    def gap(w):
        prev = F.lag("seq").over(w)
        return F.when(prev.isNull() | (prev == 0) | (F.col("seq") <= prev + 1), 0).otherwise(F.col("seq") - prev - 1)

    g = neighbour_rows(frames, REC, "frame_idx", {"_gap": gap}, before=1)
    g = g.withColumn("lost", F.when(F.col("frame_idx") + 1 > warmup, F.col("_gap")).otherwise(0).cast("bigint"))
    g = g.withColumn("_b", block_of("frame_idx", BLOCK_ROWS))
    g = running_sum(g, REC, "_b", ["frame_idx"], "lost", "lost_total").drop("_b", "_gap")
    bad = (F.col("lost") >= CATASTROPHIC_GAP) | (
        F.col("lost_total") / (F.col("frame_idx") + 1) >= CATASTROPHIC_FRACTION
    )
    return g.withColumn("catastrophic", bad)


def drop_summary(frames: DataFrame, warmup: int = 30) -> DataFrame:
    return drop_monitor(frames, warmup).groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("observed"), F.max("lost_total").alias("lost_total"),
        F.max("lost").alias("largest_gap"), F.min(F.when(F.col("catastrophic"), F.col("frame_idx"))).alias("ended_at"),
    )


def state_sessions(stim: DataFrame) -> DataFrame:
    """Contiguous runs of one state with their duration (gaps and islands, block by block)."""
    change = neighbour_rows(
        stim, REC, "frame_idx",
        {"_new": lambda w: F.when(F.lag("state").over(w).eqNullSafe(F.col("state")), 0).otherwise(1)}, before=1,
    ).withColumn("_b", block_of("frame_idx", BLOCK_ROWS))
    runs = running_sum(change, REC, "_b", ["frame_idx"], "_new", "run")
    return runs.groupBy("rec_id", "run", "state").agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count(F.lit(1)).alias("n_frames")
    ).withColumn("duration_us", F.col("end_us") - F.col("start_us"))


def rate_validation(frames: DataFrame, reported_hz: float, warmup: int, ts: str = "hw_us") -> DataFrame:
    """Measured rate with its 95 % interval against the reported rate, after a warm-up."""
    kept = frames.filter(F.col("frame_idx") >= warmup).withColumn("frame_idx", F.col("frame_idx") - warmup)
    d = frame_deltas(kept, ts).filter("delta IS NOT NULL")
    g = d.groupBy("rec_id").agg(
        F.count("delta").alias("n"), F.avg("delta").alias("_m"), F.stddev_pop("delta").alias("jitter_us")
    )
    ci = F.col("jitter_us") * 1.96 / F.sqrt("n")
    g = g.withColumns(
        {
            "measured_hz": safe_div(F.lit(1e6), "_m"),
            "ci95_hz": (safe_div(F.lit(1e6), F.col("_m") - ci) - safe_div(F.lit(1e6), F.col("_m") + ci)) / 2.0,
        }
    )
    off = F.abs(F.col("measured_hz") - reported_hz) / reported_hz
    g = g.withColumn("matches_reported", off < 0.05)
    warn = F.array_compact(
        F.array(
            _note(safe_div("ci95_hz", "measured_hz") > 0.02, F.lit("uncertain rate")),
            _note(~F.col("matches_reported"), F.lit("rate mismatch")),
        )
    )
    return g.withColumn("warnings", warn).drop("_m")


def acquisition_verdict(summary: DataFrame, sweeps: DataFrame, reliability: DataFrame) -> DataFrame:
    """Pass or fail per recording with the reasons.

    `summary` comes from `quality_summary`; display timing is judged only where it was physically timed,
    reliability only with at least two sweeps and must be finite and in [0, 1].
    """
    n = sweeps.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_sweeps"))
    v = F.col("reliability")
    bad = v.isNotNull() & (F.isnan(v) | (v < 0) | (v > 1))
    r = reliability.groupBy("rec_id").agg(F.max(bad).alias("_bad"), F.avg("reliability").alias("mean_reliability"))
    j = summary.join(n, REC, "left").join(r, REC, "left").withColumn("n_sweeps", F.coalesce("n_sweeps", F.lit(0)))
    reasons = F.array_compact(
        F.array(
            _note(F.col("camera_drops") > 0, F.lit("camera drops")),
            _note(F.col("validatable") & (F.col("stimulus_drops") > 0), F.lit("stimulus drops")),
            _note((F.col("n_sweeps") >= 2) & F.coalesce("_bad", F.lit(False)), F.lit("reliability out of range")),
        )
    )
    return j.withColumn("failures", reasons).withColumn("passed", F.size("failures") == 0).drop("_bad")
