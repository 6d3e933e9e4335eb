"""Views that read the driver's tables as recordings: traces, rasters, schedules and telemetry.

Every view exists twice: as a DataFrame here, and as SQL in `catalog.sqlviews` for the cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTIONS = ["azi_fwd", "azi_rev", "alt_fwd", "alt_rev"]
# A block of pixels makes eight recordings: seven frames of one size and a taller one from what is left.
PER_BLOCK = 8
TRACE_BLOCK, TRACE_PX, TRACE_W = 125, 15, 5  # frames of 3 x 5 and 4 x 5
RASTER_BLOCK, RASTER_PX, RASTER_W = 500, 60, 10  # frames of 6 x 10 and 8 x 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def direction_name(number: Column) -> Column:
    out = F.when(number == 0, F.lit(DIRECTIONS[0]))
    for i in (1, 2, 3):
        out = out.when(number == i, F.lit(DIRECTIONS[i]))
    return out


def _frames(pixel: Column, block: int, px: int, width: int) -> dict[str, Column]:
    """Recording, frame size and place of a running pixel number."""
    at = pixel % block
    part = F.least(F.floor(at / px), F.lit(PER_BLOCK - 1)).cast("bigint")
    left = at - part * px
    tall = (block - px * (PER_BLOCK - 1)) // width
    return {
        "rec_id": F.floor(pixel / block) * PER_BLOCK + part,
        "height": F.when(part == PER_BLOCK - 1, tall).otherwise(px // width).cast("int"),
        "width": F.lit(width),
        "y": F.floor(left / width).cast("int"),
        "x": (left % width).cast("int"),
    }


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples: one pixel row per (direction, cycle, frame in cycle)."""
    return trace_of(table(spark, sf_dir, "embeddings"))


def trace_of(embeddings: DataFrame) -> DataFrame:
    place = _frames(F.expr("vec_id div 4"), TRACE_BLOCK, TRACE_PX, TRACE_W)
    e = embeddings.select(
        *[c.alias(n) for n, c in place.items()],
        direction_name(F.col("vec_id") % 4).alias("direction"),
        F.posexplode("embedding").alias("i", "e"),
    )
    return e.select(
        "rec_id", "direction", "y", "x", "height", "width",
        F.expr("CAST(i div 16 AS INT)").alias("cycle"),
        (F.col("i") % 16).alias("k"),
        (F.lit(1000.0) * (F.lit(1.0) + F.col("e").cast("double"))).alias("v"),
    )


def movie_frame_index() -> Column:
    d = F.when(F.col("direction") == "azi_fwd", 0)
    for i in (1, 2, 3):
        d = d.when(F.col("direction") == DIRECTIONS[i], i)
    return (d * 64 + F.col("cycle") * 16 + F.col("k")).cast("bigint")


def movie_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera movie, one image row per record, laid out as 16 blocks of 16 frames at 10 Hz."""
    t = trace(spark, sf_dir)
    idx = movie_frame_index()
    # one image row, every count at its place; null where the table ends inside a frame
    cells = F.array(*[F.max(F.when(F.col("x") == x, F.round("v").cast("int"))) for x in range(TRACE_W)])
    rows = t.groupBy("rec_id", idx.alias("frame_idx"), "y", "height", "width").agg(cells.alias("pixels"))
    return rows.select(
        "rec_id", "frame_idx", (F.col("frame_idx") * 0.1).alias("ts_sec"), "y", "height", "width", "pixels"
    )


def stored_movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movie as a lake holds it: a table, so that headers and pixels are separate pruned scans."""
    from phasemill.session import cut

    return cut(movie_rows(spark, sf_dir))


def movie_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of `movie_rows`: 12 of every 16 frames are stimulus, the rest is rest."""
    labels = F.array(*[F.lit(s) for s in ("LR", "RL", "TB", "BT")])
    recs = table(spark, sf_dir, "embeddings").select(
        _frames(F.expr("vec_id div 4"), TRACE_BLOCK, TRACE_PX, TRACE_W)["rec_id"].alias("rec_id")
    ).distinct()
    s = recs.select("rec_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("sweep_idx"))
    start = F.col("sweep_idx") * 16 * 0.1
    return s.select(
        "rec_id", "sweep_idx",
        F.element_at(labels, F.expr("CAST(sweep_idx div 4 AS INT)") + 1).alias("label"),
        start.alias("start_sec"), (start + 1.15).alias("end_sec"),
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters with two signal planes, two position planes and a given area label.

    Each recording of a block reads its own eight elements of the vectors.
    """
    e = table(spark, sf_dir, "embeddings")
    place = _frames(F.col("vec_id"), RASTER_BLOCK, RASTER_PX, RASTER_W)

    def plane(i):
        return F.element_at("embedding", ((place["rec_id"] % PER_BLOCK) * 8 + i + 1).cast("int")).cast("double")

    return e.select(
        *[c.alias(n) for n, c in place.items()],
        plane(0).alias("v"), plane(1).alias("w"),
        (plane(2) * 100.0).alias("alt"), (plane(3) * 100.0).alias("azi"),
        F.abs(plane(4)).alias("det"), (F.lit(1.0) - F.abs(plane(5))).alias("q"),
        F.col("label").cast("int").alias("label"),
    )


def raster_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).filter("v > 0").select("rec_id", "height", "width", "y", "x")


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame headers: per-user events as camera frames (index, hardware µs, system µs, sequence)."""
    from phasemill.operators.blocks import HOUR_US, block_of, index_rows

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("rec_id"),
        us.alias("hw_us"),
        (us + (F.col("value") * 100).cast("bigint")).alias("sys_us"),
        F.col("event_id").alias("seq"),
        "value",
        "event_type",
    )
    e = e.withColumn("_b", block_of("hw_us", 24 * HOUR_US))
    return index_rows(e, ["rec_id"], "_b", ["hw_us", "seq"], "frame_idx").drop("_b")


def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule from four of the event types; a sweep ends at the next event or after six hours."""
    from phasemill.operators.blocks import neighbour_rows

    label = (
        F.when(F.col("event_type") == "click", "LR").when(F.col("event_type") == "view", "RL")
        .when(F.col("event_type") == "signup", "TB").when(F.col("event_type") == "purchase", "BT")
    )
    s = neighbour_rows(
        stamps(spark, sf_dir), ["rec_id"], "frame_idx",
        {"nxt": lambda w: F.lead("hw_us").over(w)}, after=1,
    )
    six = F.col("hw_us") + 6 * 3_600_000_000
    return (
        s.withColumn("label", label)
        .filter("label IS NOT NULL")
        .select(
            "rec_id", F.col("frame_idx").alias("sweep_idx"), "label",
            (F.col("hw_us") / 1e6).alias("start_sec"),
            (F.least(F.coalesce("nxt", six), six) / 1e6).alias("end_sec"),
        )
    )


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps(spark, sf_dir).select("rec_id", "frame_idx", (F.col("hw_us") / 1e6).alias("ts_sec"))


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens and sweep parameters from parts."""
    kind = F.col("p_partkey") % 3
    env = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rig_id"),
        F.when(kind == 0, "cartesian").when(kind == 1, "spherical").otherwise("cylindrical").alias("projection"),
        F.when(env == 0, "bar").when(env == 1, "wedge").when(env == 2, "ring").otherwise("fullfield").alias("envelope"),
        F.col("p_size").cast("double").alias("speed"),
        (F.pmod(F.col("p_retailprice"), F.lit(40.0)) + 1.0).alias("width_deg"),
        (F.col("p_partkey") % 30 + 10).cast("double").alias("distance"),
        (F.col("p_size") + 20).cast("double").alias("width_cm"),
        (F.col("p_size") + 10).cast("double").alias("height_cm"),
        (F.col("p_partkey") % 7).cast("double").alias("bisector_x"),
        (F.col("p_partkey") % 5).cast("double").alias("bisector_y"),
        (F.col("p_partkey") % 11 - 5).cast("double").alias("azi0"),
        (F.col("p_partkey") % 13 - 6).cast("double").alias("alt0"),
        ((F.col("p_partkey") % 101) / 101.0).alias("u"),
        ((F.col("p_partkey") % 97) / 97.0).alias("v"),
    )
