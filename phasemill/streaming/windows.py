"""Event-time windows over frame telemetry. The same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasemill.operators.blocks import block_of


def intensity_windows(frames: DataFrame, value: str, width: str, watermark: str | None = None) -> DataFrame:
    """Mean intensity per recording and tumbling window."""
    src = frames.withWatermark("ts", watermark) if watermark else frames
    g = src.groupBy("rec_id", F.window("ts", width).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_intensity")
    )
    return g.select("rec_id", F.unix_micros("_w.start").alias("start_us"), "n", "mean_intensity")


def rate_windows(frames: DataFrame, width: str, slide: str, watermark: str | None = None) -> DataFrame:
    """Frames per second per recording in sliding windows."""
    src = frames.withWatermark("ts", watermark) if watermark else frames
    g = src.groupBy("rec_id", F.window("ts", width, slide).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    sec = (F.unix_micros("_w.end") - F.unix_micros("_w.start")) / 1e6
    return g.select("rec_id", F.unix_micros("_w.start").alias("start_us"), "n", (F.col("n") / sec).alias("fps"))


def session_windows(stim: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Runs of one state per recording, closed by a pause longer than `gap`."""
    src = stim.withWatermark("ts", watermark) if watermark else stim
    g = src.groupBy("rec_id", "state", F.session_window("ts", gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_frames"), F.max("ts").alias("_last")
    )
    return g.select(
        "rec_id", "state", F.unix_micros("_w.start").alias("start_us"), F.unix_micros("_last").alias("end_us"), "n_frames"
    )


def late_rows(frames: DataFrame, arrival: str, time_us: str, delay_us: int, block: int = 65_536) -> DataFrame:
    """Rows older than the highest time seen before them minus the delay, in arrival order.

    The running maximum spans the whole stream, so it is taken per arrival block and carried over one
    summary row per block.
    """
    b = frames.withColumn("_blk", block_of(arrival, block))
    tops = b.groupBy("_blk").agg(F.max(time_us).alias("_top"))
    # the carry itself goes in two levels: blocks within a group of blocks, then groups
    past = Window.unboundedPreceding
    tops = tops.withColumn("_grp", block_of("_blk", block))
    groups = tops.groupBy("_grp").agg(F.max("_top").alias("_gtop"))
    across = Window.orderBy("_grp").rowsBetween(past, -1)  # one row per block² arrivals
    groups = groups.select("_grp", F.max("_gtop").over(across).alias("_gcarry"))
    inside = Window.partitionBy("_grp").orderBy("_blk").rowsBetween(past, -1)
    carry = tops.withColumn("_in", F.max("_top").over(inside)).join(groups, "_grp").select(
        "_blk", F.greatest("_in", "_gcarry").alias("_carry")
    )
    within = Window.partitionBy("_blk").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    j = b.withColumn("_seen", F.max(time_us).over(within)).join(carry, "_blk")
    seen = F.greatest("_seen", "_carry")
    return j.filter(F.col(time_us) < seen - delay_us).drop("_blk", "_seen", "_carry")
