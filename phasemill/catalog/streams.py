"""Streaming queries, drained to a table and checked against the SQL of their batch twins."""

import uuid

from pyspark.sql import functions as F

from phasemill.catalog.quality import _DM
from phasemill.catalog.registry import query
from phasemill.functions.columns import r6
from phasemill.operators import timebase as tb
from phasemill.session import cut, ensure_checkpoint_dir
from phasemill.sources import views
from phasemill.streaming import stateful as st
from phasemill.streaming import windows as wn


def _events(spark, d):
    e = st.stream_table(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "rec_id")


@query(
    "stream_intensity",
    """SELECT user_id AS rec_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_intensity FROM events GROUP BY ALL""",
)
def _(spark, d):
    w = wn.intensity_windows(_events(spark, d), "value", "1 hour", "2 hours")
    t = st.run_to_table(w, "update", ["rec_id", "start_us"])
    return t.select("rec_id", "start_us", "n", r6("mean_intensity").alias("mean_intensity"))


@query(
    "stream_fps",
    """SELECT rec_id, epoch_us(w) AS start_us, count(*) AS n, round(count(*) / CAST(86400 AS DOUBLE) * 1e6, 6) + 0.0 AS micro_fps FROM
         (SELECT user_id AS rec_id, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY rec_id, w""",
)
def _(spark, d):
    t = st.run_to_table(wn.rate_windows(_events(spark, d), "24 hours", "12 hours", "2 hours"), "update", ["rec_id", "start_us"])
    return t.select("rec_id", "start_us", "n", r6(F.col("fps") * 1e6).alias("micro_fps"))


@query("stream_drops", _DM, "v_stamps")
def _(spark, d):
    e = _events(spark, d).select(
        "rec_id", "ts", F.expr("event_id div 200").alias("seq"), F.col("event_id").alias("frame_idx")
    )
    t = st.run_to_table(st.stream_drops(e, 10), "update", ["rec_id"])
    # a live stream carries no frame index, so the frame is named by its event; translate it back
    idx = views.stamps(spark, d).select("rec_id", F.col("seq").alias("ended_at"), "frame_idx")
    return t.join(idx, ["rec_id", "ended_at"], "left").select(
        "rec_id", "observed", "lost_total", "largest_gap", F.col("frame_idx").alias("ended_at")
    )


@query(
    "stream_loss",
    """SELECT user_id AS rec_id, epoch_us(time_bucket(INTERVAL 24 HOUR, ts)) AS start_us, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS n,
         max(event_id) - min(event_id) + 1 - count(*) AS lost FROM events GROUP BY ALL""",
)
def _(spark, d):
    e = _events(spark, d).withColumnRenamed("event_id", "seq")
    return st.run_to_table(st.stream_loss(e, "24 hours"), "update", ["rec_id", "start_us"])


@query(
    "stream_sweeps",
    """SELECT rec_id, hw_us AS start_us, n AS end_us, n - hw_us AS duration_us FROM (SELECT *, lead(hw_us) OVER w AS n, lead(event_type) OVER w AS k
         FROM v_stamps WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY rec_id ORDER BY hw_us, seq)) WHERE event_type = 'click' AND k = 'view'""",
    "v_stamps",
)
def _(spark, d):
    kind = F.when(F.col("event_type") == "click", "started").when(F.col("event_type") == "view", "completed")
    e = _events(spark, d).select("rec_id", "ts", F.unix_micros("ts").alias("ts_us"), kind.alias("kind"), F.col("event_id").alias("ord"))
    return st.run_to_table(st.stream_sweeps(e), "append")


def _in_three(spark, rows, order):
    """A stream of the table in three equal numbers of files that arrive one third after another, cut by ranges of `order`."""
    top = rows.agg(F.max(order)).first()[0] or 0
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    third = F.least(F.floor(F.col(order) * 3 / (top + 1)), F.lit(2))
    counts = dict(rows.groupBy(third).count().collect())
    least, most = min(counts.get(i, 0) for i in range(3)), max([0, *counts.values()])
    # a trigger takes one third, so every third has as many files; each gets rows enough that none stays empty
    files = max(min(least // 10_000, max(spark.sparkContext.defaultParallelism, most // 1_000_000)), 1)
    for part in range(3):
        some = rows.filter(third == part)
        (some.repartition(files) if files > 1 else some.coalesce(1)).write.mode("append").parquet(folder)
        if files > 1 and len(spark.read.schema(rows.schema).parquet(folder).inputFiles()) != files * (part + 1):
            raise RuntimeError(f"third {part} is not in {files} files")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query(
    "stream_sessions",
    """WITH e AS (SELECT user_id AS rec_id, event_type AS state, epoch_us(ts) AS t FROM events),
       n AS (SELECT *, CASE WHEN t - lag(t) OVER w < 86400000000 THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY rec_id, state ORDER BY t)),
       r AS (SELECT *, sum(c) OVER (PARTITION BY rec_id, state ORDER BY t) AS run FROM n)
       SELECT rec_id, state, min(t) AS start_us, max(t) AS end_us, count(*) AS n_frames FROM r GROUP BY rec_id, state, run
       HAVING max(t) // 1000 + 86400000 <= (SELECT max(t) // 1000 FROM e) - 3600000""",
)
def _(spark, d):
    # as a stream: sessions that the watermark, an hour behind the newest event, has closed
    e = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.select(F.col("user_id").alias("rec_id"), F.col("event_type").alias("state"), "ts", F.unix_micros("ts").alias("us"))
    day = cut(e.withColumn("day", F.floor((F.col("us") - e.agg(F.min("us")).first()[0]) / 86_400_000_000)))
    return st.run_to_table(wn.session_windows(_in_three(spark, day, "day"), "24 hours", "1 hour"), "append")


@query(
    "stream_cycles",
    """WITH w AS (SELECT rec_id, direction, CAST(row_number() OVER (PARTITION BY rec_id, direction ORDER BY sweep_idx) - 1 AS INTEGER) AS cycle, sweep_idx * 16 AS onset, start_sec
         FROM (SELECT *, CASE label WHEN 'LR' THEN 'azi_fwd' WHEN 'RL' THEN 'azi_rev' WHEN 'TB' THEN 'alt_fwd' ELSE 'alt_rev' END AS direction FROM v_movie_sweeps)
         WHERE start_sec + 1.15 <= 25.5)
       SELECT m.rec_id, w.direction, w.cycle, m.y, m.x, count(*) AS n, round(sum(p * cos(-2*pi()*(frame_idx - onset)/12)), 6) + 0.0 AS re, round(sum(p * sin(-2*pi()*(frame_idx - onset)/12)), 6) + 0.0 AS im
       FROM v_movie m JOIN w ON m.rec_id = w.rec_id AND m.frame_idx >= w.onset AND m.frame_idx < w.onset + 12
       WHERE start_sec + 1.2 < (SELECT max(frame_idx) * 0.1 FROM v_movie) - 2 GROUP BY m.rec_id, w.direction, w.cycle, m.y, m.x""",
    "v_movie v_movie_sweeps",
)
def _(spark, d):
    from phasemill.operators import project

    movie = views.stored_movie(spark, d)
    w = st.cycle_ends(tb.number_cycles(tb.cycle_windows(views.movie_sweeps(spark, d), project.frame_headers(movie))))
    day = 1_700_000_000  # the movie's clock starts at zero; event times do at some day
    w = w.withColumn("end_us", F.col("end_us") + day * 1_000_000)
    rows = movie.withColumn("ts", F.timestamp_micros(F.col("frame_idx") * 100_000 + day * 1_000_000))
    t = st.run_to_table(st.stream_cycles(_in_three(spark, rows, "frame_idx"), w, lateness_ms=2_000), "append", by=["late"])
    px = t.filter("NOT late").select("rec_id", "direction", "cycle", "y", "n", F.posexplode(F.arrays_zip("re", "im")).alias("x", "c")).filter("c.re IS NOT NULL")
    return px.select("rec_id", "direction", "cycle", "y", "x", "n", r6("c.re").alias("re"), r6("c.im").alias("im"))


@query(
    "session_windows",
    """WITH e AS (SELECT user_id AS rec_id, event_type AS state, epoch_us(ts) AS t FROM events),
       n AS (SELECT *, CASE WHEN t - lag(t) OVER w < 86400000000 THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY rec_id, state ORDER BY t)),
       r AS (SELECT *, sum(c) OVER (PARTITION BY rec_id, state ORDER BY t) AS run FROM n)
       SELECT rec_id, state, min(t) AS start_us, max(t) AS end_us, count(*) AS n_frames FROM r GROUP BY rec_id, state, run""",
)
def _(spark, d):
    # the batch form; `stream_sessions` runs it as a stream
    e = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumnRenamed("user_id", "rec_id").withColumnRenamed("event_type", "state")
    return wn.session_windows(e, "24 hours")


@query(
    "stream_bin1",
    """WITH w AS (SELECT rec_id, direction, CAST(row_number() OVER (PARTITION BY rec_id, direction ORDER BY sweep_idx) - 1 AS INTEGER) AS cycle, sweep_idx * 16 AS onset
         FROM (SELECT *, CASE label WHEN 'LR' THEN 'azi_fwd' WHEN 'RL' THEN 'azi_rev' WHEN 'TB' THEN 'alt_fwd' ELSE 'alt_rev' END AS direction FROM v_movie_sweeps)
         WHERE start_sec + 1.15 <= 25.5)
       SELECT m.rec_id, w.direction, w.cycle, m.y, m.x, round(sum(p * cos(-2*pi()*(frame_idx - onset)/12)), 6) + 0.0 AS re, round(sum(p * sin(-2*pi()*(frame_idx - onset)/12)), 6) + 0.0 AS im
       FROM v_movie m JOIN w ON m.rec_id = w.rec_id AND m.frame_idx >= w.onset AND m.frame_idx < w.onset + 12 GROUP BY m.rec_id, w.direction, w.cycle, m.y, m.x""",
    "v_movie v_movie_sweeps",
)
def _(spark, d):
    from phasemill.operators import project

    heads = project.frame_headers(views.stored_movie(spark, d))
    w = tb.number_cycles(tb.cycle_windows(views.movie_sweeps(spark, d), heads))
    px = views.trace_of(st.stream_table(spark, d, "embeddings"))
    px = px.select(
        "rec_id", views.movie_frame_index().alias("frame_idx"), "height", "width", "y", "x", F.round("v").alias("v")
    )
    keys = ["rec_id", "direction", "cycle", "height", "width", "y", "x"]
    t = st.run_to_table(st.stream_bin1(px, w), "update", keys)
    return t.select("rec_id", "direction", "cycle", "y", "x", r6("re").alias("re"), r6("im").alias("im"))
