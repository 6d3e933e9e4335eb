"""Queries over acquisition quality, in batch."""

from pyspark.sql import functions as F

from phasemill.catalog.frames import LAGGED
from phasemill.catalog.registry import query
from phasemill.functions.columns import r6
from phasemill.operators import telemetry as tm
from phasemill.operators import timebase as tb
from phasemill.sources import views


def rnd(df, keys, values, digits=6):
    return df.select(*keys, *[r6(v, digits).alias(v) for v in values])


_CQ = f"""SELECT rec_id, count(*) AS n_frames, (max_by(hw_us, frame_idx) - min_by(hw_us, frame_idx)) / CAST(1e6 AS DOUBLE) AS sec,
    any_value(m) AS med, coalesce(stddev_pop(delta), 0) AS jit, CAST(coalesce(sum(CASE WHEN gap > 1 THEN gap - 1 END), 0) AS BIGINT) AS drops,
    count(*) FILTER (WHERE frame_idx - 1 >= 5 AND delta > m * 3.0) AS late, max(delta) AS max_delta_us
  FROM ({LAGGED}) JOIN (SELECT rec_id, median(delta) AS m FROM ({LAGGED}) GROUP BY rec_id) USING (rec_id) GROUP BY rec_id"""


@query(
    "capture_quality",
    f"""SELECT rec_id, n_frames, round(sec, 6) + 0.0 AS duration_sec, round((n_frames - 1) / sec * 1e6, 4) + 0.0 AS micro_fps, round(med, 2) + 0.0 AS median_period_us,
          round(jit, 1) + 0.0 AS jitter_us, round(jit / med, 6) + 0.0 AS jitter_fraction, drops AS sequence_drops, late AS timing_anomalies, max_delta_us,
          NOT (drops > 0 OR late > 0 OR jit / med > 0.9) AS passed, (CASE WHEN drops > 0 THEN 1 ELSE 0 END) + (CASE WHEN late > 0 THEN 1 ELSE 0 END)
            + (CASE WHEN jit / med > 0.9 THEN 1 ELSE 0 END) AS n_failures FROM ({_CQ})""",
    "v_stamps",
)
def _(spark, d):
    q = tm.capture_quality(views.stamps(spark, d), 3.0, 5, 0.9)
    return q.select(
        "rec_id", "n_frames", r6("duration_sec").alias("duration_sec"), r6(F.col("mean_fps") * 1e6, 4).alias("micro_fps"),
        r6("median_period_us", 2).alias("median_period_us"), r6("jitter_us", 1).alias("jitter_us"),
        r6("jitter_fraction").alias("jitter_fraction"), "sequence_drops", "timing_anomalies", "max_delta_us", "passed",
        F.size("failures").alias("n_failures"),
    )


_TC = f"""WITH d AS (SELECT rec_id, frame_idx, hw_us - lag(hw_us) OVER w AS cam, shown - lag(shown) OVER w AS stim
      FROM (SELECT *, sys_us + frame_idx * 60000000 AS shown FROM v_stamps) WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx)),
    s AS (SELECT rec_id, avg(cam) / 1e6 AS tc, avg(stim) / 1e6 AS ts, stddev_pop(cam) / 1e6 AS jc,
          stddev_pop(stim) / 1e6 AS js FROM d GROUP BY rec_id),
    u AS (SELECT rec_id, count(*) AS n, stddev_pop(CAST(sys_us - hw_us AS DOUBLE)) AS unc FROM v_stamps GROUP BY rec_id),
    b AS (SELECT *, 1 / abs(1 / tc - 1 / ts) AS beat, sqrt(power(unc / 1e6, 2) + jc * jc + js * js) AS onset FROM s JOIN u USING (rec_id))
  SELECT rec_id, round(tc, 4) + 0.0 AS t_cam, round(ts, 4) + 0.0 AS t_stim, round(tc / ts, 6) + 0.0 AS rate_ratio, round((ts % tc) / tc, 6) + 0.0 AS phase_increment,
    CASE WHEN beat < 40000 THEN 'uniform' WHEN beat > 400000 THEN 'systematic' ELSE 'partial' END AS regime,
    round(least(400000 / beat, 1), 6) + 0.0 AS phase_coverage, round(n * least(400000 / beat, 1), 5) + 0.0 AS phase_samples, round(onset / tc, 6) + 0.0 AS onset_fraction,
    (CASE WHEN beat > 400000 THEN 1 ELSE 0 END) + (CASE WHEN beat BETWEEN 40000 AND 400000 AND 400000 / beat < 0.5 THEN 1 ELSE 0 END) + (CASE WHEN onset / tc > 0.5 THEN 1 ELSE 0 END) AS n_warnings
  FROM b"""


@query("timing_characterization", _TC, "v_stamps")
def _(spark, d):
    s = views.stamps(spark, d)
    cam = tb.frame_deltas(s).select("rec_id", "delta")
    # a display that falls behind by a minute a frame, so that both clocks differ
    shown = s.withColumn("show_us", F.col("sys_us") + F.col("frame_idx") * 60_000_000)
    stim = tb.frame_deltas(shown, "show_us").select("rec_id", "delta")
    n = s.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_trials"))
    unc = tm.clock_offset_uncertainty(s).withColumnRenamed("uncertainty_us", "clock_uncertainty_us")
    params = n.join(unc, "rec_id").withColumn("inter_trial_sec", F.lit(40000.0)).withColumn("session_sec", F.lit(400000.0))
    t = tm.timing_characterization(cam, stim, params)
    return t.select(
        "rec_id", r6("t_cam", 4).alias("t_cam"), r6("t_stim", 4).alias("t_stim"), r6("rate_ratio").alias("rate_ratio"),
        r6("phase_increment").alias("phase_increment"), "regime", r6("phase_coverage").alias("phase_coverage"),
        r6("phase_samples", 5).alias("phase_samples"), r6("onset_fraction").alias("onset_fraction"),
        F.size("warnings").alias("n_warnings"),
    )


@query(
    "clock_offset_uncertainty",
    "SELECT rec_id, round(stddev_pop(CAST(sys_us - hw_us AS DOUBLE)), 4) + 0.0 AS uncertainty_us FROM v_stamps GROUP BY rec_id",
    "v_stamps",
)
def _(spark, d):
    return rnd(tm.clock_offset_uncertainty(views.stamps(spark, d)), ["rec_id"], ["uncertainty_us"], 4)


def _summary(spark, d):
    s = views.stamps(spark, d)
    recs = s.select("rec_id").distinct().withColumns(
        {"complete": F.col("rec_id") % 3 != 0, "validatable": F.col("rec_id") % 2 == 0}
    )
    inten = s.select("rec_id", "frame_idx", F.col("value").alias("mean_intensity"))
    return tm.quality_summary(s, s, recs, inten, fps=1e-4, threshold=1.5, warmup=5)


_QS = f"""SELECT rec_id, rec_id % 3 <> 0 AS complete, rec_id % 2 = 0 AS validatable, count(*) FILTER (WHERE gap <> 1) AS camera_drops,
    count(*) FILTER (WHERE frame_idx >= 5 AND delta > 10000000000 * CAST(1.5 AS DOUBLE)) AS stimulus_drops,
    round(min(value), 6) + 0.0 AS min_intensity, round(max(value), 6) + 0.0 AS max_intensity,
    CASE WHEN rec_id % 2 = 0 THEN 'physical' ELSE 'remote_virtual' END AS display_scanout FROM ({LAGGED}) GROUP BY rec_id"""


@query("quality_summary", _QS, "v_stamps")
def _(spark, d):
    s = _summary(spark, d)
    return s.select(
        "rec_id", "complete", "validatable", "camera_drops", "stimulus_drops", r6("min_intensity").alias("min_intensity"),
        r6("max_intensity").alias("max_intensity"), "display_scanout",
    )


@query(
    "sweep_intervals",
    """SELECT rec_id, hw_us AS start_us, n AS end_us, n - hw_us AS duration_us FROM (SELECT *, lead(hw_us) OVER w AS n, lead(event_type) OVER w AS k
         FROM v_stamps WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY rec_id ORDER BY hw_us, seq)) WHERE event_type = 'click' AND k = 'view'""",
    "v_stamps",
)
def _(spark, d):
    kind = F.when(F.col("event_type") == "click", "started").when(F.col("event_type") == "view", "completed")
    e = views.stamps(spark, d).select("rec_id", F.col("hw_us").alias("ts_us"), kind.alias("kind"), F.col("seq").alias("ord"))
    return tm.sweep_intervals(e)


_DM = """WITH g AS (SELECT *, CASE WHEN p IS NULL OR p = 0 OR s <= p + 1 OR frame_idx + 1 <= 10 THEN 0 ELSE s - p - 1 END AS lost FROM
      (SELECT rec_id, frame_idx, CAST(seq // 200 AS BIGINT) AS s, lag(CAST(seq // 200 AS BIGINT)) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS p FROM v_stamps)),
    c AS (SELECT *, CAST(sum(lost) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS BIGINT) AS lost_total FROM g)
  SELECT rec_id, count(*) AS observed, max(lost_total) AS lost_total, max(lost) AS largest_gap,
    min(CASE WHEN lost >= 60 OR lost_total / (frame_idx + 1) >= 0.05 THEN frame_idx END) AS ended_at FROM c GROUP BY rec_id"""


@query("drop_monitor", _DM, "v_stamps")
def _(spark, d):
    s = views.stamps(spark, d).withColumn("seq", F.expr("seq div 200"))
    return tm.drop_summary(s, 10)


@query(
    "state_sessions",
    """WITH n AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND frame_idx > 0 THEN 0 ELSE 1 END AS c FROM v_stamps WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx)),
       r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS BIGINT) AS run FROM n)
       SELECT rec_id, run, event_type AS state, min(hw_us) AS start_us, max(hw_us) AS end_us, count(*) AS n_frames, max(hw_us) - min(hw_us) AS duration_us FROM r GROUP BY rec_id, run, event_type""",
    "v_stamps",
)
def _(spark, d):
    s = views.stamps(spark, d).select("rec_id", "frame_idx", F.col("hw_us").alias("ts_us"), F.col("event_type").alias("state"))
    return tm.state_sessions(s)


@query(
    "rate_validation",
    """WITH d AS (SELECT rec_id, hw_us - lag(hw_us) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS d FROM v_stamps WHERE frame_idx >= 5),
       g AS (SELECT rec_id, count(d) AS n, avg(d) AS m, stddev_pop(d) AS j FROM d GROUP BY rec_id HAVING count(d) > 0),
       h AS (SELECT *, 1e6 / m AS hz, (1e6 / (m - 1.96 * j / sqrt(n)) - 1e6 / (m + 1.96 * j / sqrt(n))) / 2 AS ci FROM g)
       SELECT rec_id, n, round(j, 1) + 0.0 AS jitter_us, round(hz * 1e6, 4) + 0.0 AS micro_hz, round(ci * 1e6, 4) + 0.0 AS ci_micro_hz,
         abs(hz - 2.5e-5) / 2.5e-5 < 0.05 AS matches_reported, (CASE WHEN ci / hz > 0.02 THEN 1 ELSE 0 END) + (CASE WHEN abs(hz - 2.5e-5) / 2.5e-5 < 0.05 THEN 0 ELSE 1 END) AS n_warnings FROM h""",
    "v_stamps",
)
def _(spark, d):
    r = tm.rate_validation(views.stamps(spark, d), 2.5e-5, 5)
    return r.select(
        "rec_id", "n", r6("jitter_us", 1).alias("jitter_us"), r6(F.col("measured_hz") * 1e6, 4).alias("micro_hz"),
        r6(F.col("ci95_hz") * 1e6, 4).alias("ci_micro_hz"), "matches_reported", F.size("warnings").alias("n_warnings"),
    )


@query(
    "acquisition_verdict",
    f"""WITH q AS ({_QS}), n AS (SELECT rec_id, count(*) AS n_sweeps FROM v_sweeps GROUP BY rec_id),
        r AS (SELECT rec_id, bool_or(value / 480 > 1) AS bad FROM v_stamps GROUP BY rec_id)
        SELECT rec_id, n_sweeps, (CASE WHEN camera_drops > 0 THEN 1 ELSE 0 END) + (CASE WHEN validatable AND stimulus_drops > 0 THEN 1 ELSE 0 END)
          + (CASE WHEN n_sweeps >= 2 AND bad THEN 1 ELSE 0 END) AS n_failures,
          NOT (camera_drops > 0 OR (validatable AND stimulus_drops > 0) OR (n_sweeps >= 2 AND bad)) AS passed FROM q JOIN n USING (rec_id) JOIN r USING (rec_id)""",
    "v_stamps v_sweeps",
)
def _(spark, d):
    rel = views.stamps(spark, d).select("rec_id", (F.col("value") / 480.0).alias("reliability"))
    v = tm.acquisition_verdict(_summary(spark, d), views.sweeps(spark, d), rel)
    return v.select("rec_id", "n_sweeps", F.size("failures").alias("n_failures"), "passed")


# batch twins of the streaming windows


@query(
    "windowed_intensity",
    """SELECT rec_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_intensity
       FROM (SELECT user_id AS rec_id, ts, value FROM events) GROUP BY ALL""",
)
def _(spark, d):
    from phasemill.streaming.windows import intensity_windows

    e = views.table(spark, d, "events").select(F.col("user_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return rnd(intensity_windows(e, "value", "1 hour"), ["rec_id", "start_us", "n"], ["mean_intensity"])


@query(
    "windowed_rate",
    """SELECT rec_id, epoch_us(w) AS start_us, count(*) AS n, round(count(*) / CAST(86400 AS DOUBLE) * 1e6, 6) + 0.0 AS micro_fps FROM
         (SELECT user_id AS rec_id, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY rec_id, w""",
)
def _(spark, d):
    from phasemill.streaming.windows import rate_windows

    e = views.table(spark, d, "events").select(F.col("user_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"))
    r = rate_windows(e, "24 hours", "12 hours")
    return r.select("rec_id", "start_us", "n", r6(F.col("fps") * 1e6).alias("micro_fps"))


@query(
    "late_frames",
    """WITH m AS (SELECT user_id AS rec_id, event_id, epoch_us(ts) - CASE WHEN event_id % 17 = 0 THEN 7200000000 ELSE 0 END AS t FROM events),
       h AS (SELECT *, max(t) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m)
       SELECT rec_id, count(*) AS n_late FROM h WHERE t < seen - 3600000000 GROUP BY rec_id""",
)
def _(spark, d):
    e = views.table(spark, d, "events").select(F.col("user_id").alias("rec_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    e = e.withColumn("t", F.col("t") - F.when(F.col("event_id") % 17 == 0, 7_200_000_000).otherwise(0))
    from phasemill.streaming.windows import late_rows

    return late_rows(e, "event_id", "t", 3_600_000_000).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_late"))
