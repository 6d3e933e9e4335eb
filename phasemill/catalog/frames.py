"""Queries over frame order, clocks and schedules."""

from pyspark.sql import functions as F

from phasemill.catalog.registry import query
from phasemill.functions.columns import r6
from phasemill.operators import timebase as tb
from phasemill.sources import views

LAGGED = """SELECT *, hw_us - lag(hw_us) OVER w AS delta, seq - lag(seq) OVER w AS gap FROM v_stamps
    WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx)"""


@query(
    "unify_timebase",
    """SELECT rec_id, frame_idx, round((hw_us - t0) / CAST(1e6 AS DOUBLE), 6) + 0.0 AS sec FROM v_stamps
       JOIN (SELECT rec_id, sys_us AS t0 FROM v_stamps WHERE frame_idx = 0) USING (rec_id)""",
    "v_stamps",
)
def _(spark, d):
    s = views.stamps(spark, d)
    return tb.unify_timebase(s, s, "hw_us", "sec").select("rec_id", "frame_idx", r6("sec").alias("sec"))


_DAY = "CAST(86400000000 AS BIGINT)"
_CLOCK = f"SELECT rec_id, frame_idx, sys_us, hw_us % {_DAY} AS hw FROM v_stamps"
_UNWRAP = f"""SELECT *, hw + {_DAY} * CAST(sum(CASE WHEN hw + {_DAY} // 2 < prev THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS BIGINT) AS hw_unwrapped
    FROM (SELECT *, lag(hw) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS prev FROM ({_CLOCK}))"""


def _daily_clock(spark, d):
    return views.stamps(spark, d).withColumn("hw_us", F.col("hw_us") % tb.DAY_US)


@query("unwrap_midnight", f"SELECT rec_id, frame_idx, hw AS hw_us, hw_unwrapped FROM ({_UNWRAP})", "v_stamps")
def _(spark, d):
    return tb.unwrap_midnight(_daily_clock(spark, d)).select("rec_id", "frame_idx", "hw_us", "hw_unwrapped")


@query(
    "clock_drift",
    """WITH b AS (SELECT rec_id, min_by(sys_us, frame_idx) s0, max_by(sys_us, frame_idx) s1, min_by(sys_us - hw_us, frame_idx) o0 FROM v_stamps GROUP BY rec_id),
       j AS (SELECT rec_id, s0, s1, o0, CAST(sys_us - s0 AS DOUBLE) t, CAST(sys_us - hw_us - o0 AS DOUBLE) o FROM v_stamps JOIN b USING (rec_id)),
       m AS (SELECT rec_id, avg(t) tb, avg(o) ob FROM j GROUP BY rec_id),
       f AS (SELECT rec_id, any_value(s1 - s0) dur, any_value(o0) o0, any_value(tb) tb, any_value(ob) ob,
           CASE WHEN sum((t - tb) * (t - tb)) > 0 THEN sum((t - tb) * (o - ob)) / sum((t - tb) * (t - tb)) ELSE 0 END slope
         FROM j JOIN m USING (rec_id) GROUP BY rec_id)
       SELECT rec_id, CAST(round(ob - slope * tb + o0) AS BIGINT) AS start_us, CAST(round(ob - slope * tb + slope * dur + o0) AS BIGINT) AS end_us,
         CAST(round(ob - slope * tb + slope * dur + o0) - round(ob - slope * tb + o0) AS BIGINT) AS drift_us FROM f""",
    "v_stamps",
)
def _(spark, d):
    return tb.clock_drift(views.stamps(spark, d))


@query(
    "sweep_plan",
    """SELECT o_custkey AS rec_id, cond_idx, rep, CAST(cond_idx * 3 + rep AS INTEGER) AS sequential, CAST(rep * n + cond_idx AS INTEGER) AS interleaved
       FROM (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS cond_idx,
           count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), (SELECT CAST(r AS INTEGER) AS rep FROM range(3) t(r))""",
)
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("rec_id").orderBy("o_orderkey")
    cond = views.table(spark, d, "orders").select(F.col("o_custkey").alias("rec_id"), "o_orderkey").select(
        "rec_id", (F.row_number().over(w) - 1).alias("cond_idx")
    )
    a = tb.sweep_plan(cond, 3, "sequential").withColumnRenamed("trial", "sequential")
    b = tb.sweep_plan(cond, 3, "interleaved").withColumnRenamed("trial", "interleaved")
    return a.join(b, ["rec_id", "cond_idx", "rep"])


@query(
    "sweep_plan_randomized",
    """SELECT rec_id, cond_idx, rep, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY sha256('7|' || rec_id || '|' || cond_idx || '|' || rep), cond_idx, rep) - 1 AS INTEGER) AS trial
       FROM (SELECT n_regionkey AS rec_id, n_nationkey AS cond_idx, CAST(unnest(range(4)) AS INTEGER) AS rep FROM nation)""",
)
def _(spark, d):
    cond = views.table(spark, d, "nation").select(F.col("n_regionkey").alias("rec_id"), F.col("n_nationkey").alias("cond_idx"))
    return tb.sweep_plan(cond, 4, "randomized", seed=7)


@query("frame_deltas", f"SELECT rec_id, frame_idx, delta FROM ({LAGGED})", "v_stamps")
def _(spark, d):
    return tb.frame_deltas(views.stamps(spark, d)).select("rec_id", "frame_idx", "delta")


@query("sequence_gaps", f"SELECT rec_id, frame_idx, gap FROM ({LAGGED}) WHERE gap <> 1", "v_stamps")
def _(spark, d):
    return tb.sequence_gaps(views.stamps(spark, d))


@query(
    "sequence_drops",
    f"""SELECT rec_id, CAST(coalesce(sum(CASE WHEN gap > 1 THEN gap - 1 END), 0) AS BIGINT) AS n_dropped,
          count(*) FILTER (WHERE gap <> 1) AS n_breaks FROM ({LAGGED}) GROUP BY rec_id""",
    "v_stamps",
)
def _(spark, d):
    return tb.sequence_drops(views.stamps(spark, d))


@query(
    "dropped_frames",
    f"SELECT rec_id, frame_idx, delta FROM ({LAGGED}) WHERE frame_idx >= 5 AND delta > 10000000000 * CAST(1.5 AS DOUBLE)",
    "v_stamps",
)
def _(spark, d):
    return tb.dropped_frames(views.stamps(spark, d), 1e-4, 1.5, 5)


@query(
    "rolling_fps",
    f"""SELECT rec_id, frame_idx, round(CASE WHEN frame_idx >= 2 AND m > 0 THEN 1e6 / m ELSE 0 END * 1e6, 6) + 0.0 AS micro_fps FROM
         (SELECT rec_id, frame_idx, avg(delta) OVER (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM ({LAGGED}))""",
    "v_stamps",
)
def _(spark, d):
    return tb.rolling_fps(views.stamps(spark, d), 10).select("rec_id", "frame_idx", r6(F.col("fps") * 1e6).alias("micro_fps"))


@query(
    "timing_anomalies",
    f"""SELECT rec_id, frame_idx, delta, m AS median_us FROM ({LAGGED}) JOIN
         (SELECT rec_id, CAST(median(delta) AS DOUBLE) AS m FROM ({LAGGED}) GROUP BY rec_id) USING (rec_id)
        WHERE frame_idx - 1 >= 5 AND delta > m * CAST(2.5 AS DOUBLE)""",
    "v_stamps",
)
def _(spark, d):
    return tb.timing_anomalies(views.stamps(spark, d), 2.5, 5)


DIRECTED = """SELECT *, CASE label WHEN 'LR' THEN 'azi_fwd' WHEN 'RL' THEN 'azi_rev' WHEN 'TB' THEN 'alt_fwd' ELSE 'alt_rev' END AS direction FROM v_sweeps"""

NEAREST = f"""SELECT s.rec_id, s.sweep_idx, s.direction, s.start_sec, s.end_sec, arg_min(f.frame_idx, {{'d': abs(f.ts_sec - s.start_sec), 'i': f.frame_idx}}) AS onset_idx
    FROM ({DIRECTED}) s JOIN v_times f USING (rec_id) GROUP BY ALL"""

WINDOWS = f"""SELECT n.*, chunk, frame_dur, start_sec >= ts0 AND start_sec + chunk_dur <= ts1 AND onset_idx + chunk <= n_frames AS kept
    FROM (SELECT *, CAST(ceil(chunk_dur / frame_dur) AS BIGINT) AS chunk FROM
       (SELECT rec_id, direction, avg(end_sec - start_sec) AS chunk_dur FROM ({DIRECTED}) GROUP BY ALL)
       JOIN (SELECT rec_id, count(*) AS n_frames, min(ts_sec) AS ts0, max(ts_sec) AS ts1, (max(ts_sec) - min(ts_sec)) / (count(*) - 1) AS frame_dur
             FROM v_times GROUP BY rec_id HAVING count(*) >= 2) USING (rec_id)) c
    JOIN ({NEAREST}) n USING (rec_id, direction)"""


@query("nearest_frame", f"SELECT rec_id, sweep_idx, onset_idx FROM ({NEAREST})", "v_sweeps v_times")
def _(spark, d):
    s = views.sweeps(spark, d)
    # onsets are shifted off the frame grid by the caller where needed; here they sit on it
    return tb.nearest_frame(tb.with_direction(s), views.frame_times(spark, d)).select("rec_id", "sweep_idx", "onset_idx")


@query(
    "nearest_frame_between",
    f"""SELECT s.rec_id, s.sweep_idx, arg_min(f.frame_idx, {{'d': abs(f.ts_sec - s.start_sec), 'i': f.frame_idx}}) AS onset_idx
        FROM (SELECT * REPLACE (end_sec AS start_sec) FROM v_sweeps) s JOIN v_times f USING (rec_id) GROUP BY ALL""",
    "v_sweeps v_times",
)
def _(spark, d):
    s = views.sweeps(spark, d).withColumn("start_sec", F.col("end_sec"))
    return tb.nearest_frame(s, views.frame_times(spark, d)).select("rec_id", "sweep_idx", "onset_idx")


@query("cycle_windows", f"SELECT rec_id, sweep_idx, direction, onset_idx, chunk, kept FROM ({WINDOWS})", "v_sweeps v_times")
def _(spark, d):
    return tb.cycle_windows(views.sweeps(spark, d), views.frame_times(spark, d)).select(
        "rec_id", "sweep_idx", "direction", "onset_idx", "chunk", "kept"
    )


@query(
    "attach_cycle",
    f"""SELECT w.rec_id, f.frame_idx, w.direction, w.cycle, CAST(f.frame_idx - w.onset_idx AS INTEGER) AS k FROM
          (SELECT *, CAST(row_number() OVER (PARTITION BY rec_id, direction ORDER BY sweep_idx) - 1 AS INTEGER) AS cycle FROM ({WINDOWS}) WHERE kept) w
          JOIN v_times f ON f.rec_id = w.rec_id AND f.frame_idx >= w.onset_idx AND f.frame_idx < w.onset_idx + w.chunk""",
    "v_sweeps v_times",
)
def _(spark, d):
    f = views.frame_times(spark, d)
    w = tb.number_cycles(tb.cycle_windows(views.sweeps(spark, d), f))
    return tb.attach_cycle(f, w.select("rec_id", "direction", "cycle", "onset_idx", "chunk")).select(
        "rec_id", "frame_idx", "direction", "cycle", "k"
    )


@query(
    "rest_frames",
    """SELECT rec_id, frame_idx FROM v_times f WHERE NOT EXISTS (SELECT 1 FROM v_sweeps s WHERE s.rec_id = f.rec_id
         AND f.ts_sec >= s.start_sec AND f.ts_sec <= s.end_sec)""",
    "v_sweeps v_times",
)
def _(spark, d):
    return tb.rest_frames(views.frame_times(spark, d), views.sweeps(spark, d)).select("rec_id", "frame_idx")


@query(
    "condition_lookup",
    """SELECT event_id, condition_idx, e.event_type AS condition FROM events e JOIN
         (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS condition_idx FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)""",
)
def _(spark, d):
    # conditions are a protocol list: five rows, whatever the size of the events
    e = views.table(spark, d, "events")
    names = e.select("event_type").distinct().groupBy().agg(F.array_sort(F.collect_set("event_type")).alias("a"))
    cond = names.select(F.posexplode("a").alias("i", "condition")).select(
        F.lit(1).alias("rec_id"), F.col("i").cast("bigint").alias("condition_idx"), "condition"
    )
    stim = e.join(cond, e["event_type"] == cond["condition"]).select("event_id", "rec_id", "condition_idx")
    return tb.condition_lookup(stim, cond).select("event_id", "condition_idx", "condition")
