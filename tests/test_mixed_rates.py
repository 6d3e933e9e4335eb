"""A lake whose recordings run at very different rates: time buckets follow each recording."""

import random

from phasemill.operators import telemetry, timebase


def lake(spark):
    """1 Hz for a day, 10 kHz for two seconds, two frames one microsecond apart, one single frame, and sweeps far outside."""
    r = random.Random(8)
    frames = [("slow", i, float(i)) for i in range(2000)] + [("fast", i, 50.0 + i / 10_000) for i in range(20_000)]
    frames += [("pair", 0, 10.0), ("pair", 1, 10.000001), ("one", 0, 3.0)]
    sweeps = [(rec, i, a, a + r.choice([0.0, 0.3, 40.0])) for rec, lo, hi in (("slow", -50, 2100), ("fast", 49, 53), ("pair", 9, 11)) for i, a in enumerate(r.uniform(lo, hi) for _ in range(6))]
    sweeps += [("pair", 90, 10.0, 1e9), ("slow", 91, 1990.5, 1e12), ("slow", 92, -1e12, 2.0), ("one", 0, 5.0, 4.0), ("lost", 0, 1.0, 2.0)]
    return (
        frames, sweeps, spark.createDataFrame(frames, "rec_id string, frame_idx bigint, ts_sec double"),
        spark.createDataFrame(sweeps, "rec_id string, sweep_idx int, start_sec double, end_sec double"),
    )


def test_nearest_frame_and_rest_frames_at_mixed_rates(spark):
    frames, sweeps, f, s = lake(spark)
    by_rec = {}
    for rec, i, t in frames:
        by_rec.setdefault(rec, []).append((t, i))
    want = {
        (rec, i): min(by_rec[rec], key=lambda p, a=a: (abs(p[0] - a), p[1]))[1] if rec in by_rec else None for rec, i, a, _ in sweeps
    }
    assert {(r.rec_id, r.sweep_idx): r.onset_idx for r in timebase.nearest_frame(s, f).collect()} == want
    busy = {(rec, i) for rec, i, t in frames for q, _, a, b in sweeps if q == rec and a <= t <= b}
    assert {(r.rec_id, r.frame_idx) for r in timebase.rest_frames(f, s).collect()} == {(rec, i) for rec, i, _ in frames} - busy


def test_copies_of_a_sweep_are_bounded_by_the_buckets_of_its_recording(spark):
    _, _, f, s = lake(spark)
    copies = timebase.busy_blocks(s, timebase.bucket_lengths(f, "ts_sec", 512)).groupBy("rec_id", "start_sec").count().collect()
    most = {"slow": 2000 // 512 + 2, "fast": 20_000 // 512 + 2, "pair": 2}
    assert copies and all(r["count"] <= most[r.rec_id] for r in copies)


def test_no_action_inside_the_operators(spark):
    _, _, f, s = lake(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "building plans")
    try:
        timebase.nearest_frame(s, f)
        timebase.rest_frames(f, s)
        events = f.selectExpr("rec_id", "CAST(ts_sec * 1e6 AS BIGINT) AS ts_us", "IF(frame_idx % 2 = 0, 'started', 'completed') AS kind", "frame_idx AS ord")
        telemetry.sweep_intervals(events)
        assert list(tracker.getJobIdsForGroup("lazy")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_intervals_at_mixed_rates(spark):
    _, _, f, _ = lake(spark)
    events = f.selectExpr("rec_id", "CAST(ts_sec * 1e6 AS BIGINT) AS ts_us", "IF(frame_idx % 2 = 0, 'started', 'completed') AS kind", "frame_idx AS ord")
    n = {r.rec_id: r["count"] for r in telemetry.sweep_intervals(events).groupBy("rec_id").count().collect()}
    assert n == {"slow": 1000, "fast": 10_000, "pair": 1}
