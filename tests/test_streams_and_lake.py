"""Streams against their batch twins over several micro-batches; readers, writers, contract, registry."""

import random

import pytest
from pyspark.sql import functions as F

from phasemill.operators import agree, telemetry
from phasemill.sources import lake
from phasemill.streaming import stateful, windows

STAMP = "rec_id string, ts_us bigint, seq bigint, kind string, state string, frame_idx bigint, value double"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Three files that arrive one after another, in time order."""
    rng = random.Random(2)
    rows, seq, idx = [], {"a": 5, "b": 900}, {"a": 0, "b": 0}
    for i in range(600):
        rec = "a" if i % 3 else "b"
        seq[rec] += rng.choice([1, 1, 1, 1, 1, 3, 80 if i == 400 else 1])
        kind = rng.choice(["started", "completed", "other"])
        rows.append((rec, 1_700_000_000_000_000 + i * 1_000_000, seq[rec], kind, "s" if (i // 50) % 2 else "t", idx[rec], float(i % 7)))
        idx[rec] += 1
    folder = str(tmp_path_factory.mktemp("feed"))
    for part in range(3):
        df = spark.createDataFrame(rows[part * 200:(part + 1) * 200], STAMP).withColumn("ts", F.timestamp_micros("ts_us"))
        df.coalesce(1).write.mode("append").parquet(folder)
    batch = spark.read.parquet(folder)
    return folder, batch


def stream(spark, feed):
    folder, batch = feed
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder), batch


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stream_drops_equals_batch(spark, feed):
    s, batch = stream(spark, feed)
    got = stateful.run_to_table(stateful.stream_drops(s, warmup=10, watermark="1 hour"), "update", ["rec_id"])
    want = telemetry.drop_summary(batch, 10)
    cols = ("rec_id", "observed", "lost_total", "largest_gap", "ended_at")
    assert rows_of(got, *cols) == rows_of(want, *cols)


def test_stream_sweeps_equals_batch(spark, feed):
    s, batch = stream(spark, feed)
    got = stateful.run_to_table(stateful.stream_sweeps(s.withColumn("ord", F.col("frame_idx")), watermark="1 hour"), "append")
    want = telemetry.sweep_intervals(batch.withColumn("ord", F.col("frame_idx")))
    cols = ("rec_id", "start_us", "end_us", "duration_us")
    assert rows_of(got, *cols) == rows_of(want, *cols) and got.count() > 50


def in_files(spark, folder, *parts):
    """A stream whose files arrive one after another; rows are (rec_id, second, seq, frame_idx)."""
    for part in parts:
        df = spark.createDataFrame(part, "rec_id string, s bigint, seq bigint, frame_idx bigint")
        df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).coalesce(1).write.mode("append").parquet(folder)
    batch = spark.read.parquet(folder)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder), batch


def test_recordings_of_a_stream_share_calls_and_state(spark, tmp_path):
    rng = random.Random(5)
    recs = [None, *(f"r{i}" for i in range(2 * stateful.BUCKETS))]
    parts = [[(rec, 10 * part + i, 1 + 3 * part + i + rng.randrange(9), 3 * part + i) for rec in recs for i in range(3)] for part in range(2)]
    s, batch = in_files(spark, str(tmp_path / "feed"), *parts)
    q = stateful.stream_drops(s, 2, "1 hour").writeStream.outputMode("update").format("noop")
    q = q.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert 0 < max(kept) <= stateful.BUCKETS < len(recs)
    got = stateful.run_to_table(stateful.stream_drops(s, 2, "1 hour"), "update", ["rec_id"])
    cols = ("observed", "lost_total", "largest_gap", "ended_at")
    want = {r.rec_id: tuple(r[c] for c in cols) for r in telemetry.drop_summary(batch.filter("rec_id IS NOT NULL"), 2).collect()}
    have = {r.rec_id: tuple(r[c] for c in cols) for r in got.collect()}
    assert have.pop(None)[0] == 6 and have == want


def test_a_silent_recording_leaves_its_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    s, _ = in_files(
        spark, str(tmp_path), [("a", 0, 1, 0), ("b", 0, 1, 0)], [("b", 100, 2, 1)], [("b", 200, 3, 2)], [("b", 250, 4, 3)],
        [("a", 300, 9, 1), ("b", 300, 5, 4)],
    )
    got = stateful.run_to_table(stateful.stream_drops(s, 0, "1 second", give_up_ms=120_000), "update", ["rec_id"])
    # `a` begins anew, `b` goes on
    assert rows_of(got, "rec_id", "observed", "lost_total") == [("a", 1, 0), ("b", 5, 0)]


def test_windows_equal_batch(spark, feed):
    s, batch = stream(spark, feed)
    cols = ("rec_id", "start_us", "n")
    got = stateful.run_to_table(windows.rate_windows(s, "60 seconds", "30 seconds", "10 minutes"), "update", ["rec_id", "start_us"])
    assert rows_of(got, *cols) == rows_of(windows.rate_windows(batch, "60 seconds", "30 seconds"), *cols)
    got = stateful.run_to_table(windows.intensity_windows(s, "value", "60 seconds", "10 minutes"), "update", ["rec_id", "start_us"])
    assert rows_of(got, *cols) == rows_of(windows.intensity_windows(batch, "value", "60 seconds"), *cols)


def test_session_stream_emits_closed_sessions(spark, feed):
    s, batch = stream(spark, feed)
    cols = ("rec_id", "state", "start_us", "end_us", "n_frames")
    got = set(rows_of(stateful.run_to_table(windows.session_windows(s, "20 seconds", "0 seconds"), "append"), *cols))
    want = set(rows_of(windows.session_windows(batch, "20 seconds"), *cols))
    assert got and got <= want
    assert len(want - got) <= 4  # the sessions still open at the end


def movie_feed(spark, folder, order, frames=200, chunk=12):
    """Image rows of two recordings in one file per list of frames; a last frame an hour later ends every cycle."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rng = random.Random(5)
    of = {(r, f, y): [rng.randrange(100) for _ in range(3)] for r in ("a", "b") for f in range(frames) for y in range(2)}
    schema = "rec_id string, ts timestamp, frame_idx bigint, height int, width int, y int, pixels array<int>"
    row = lambda r, f, y: (r, start + dt.timedelta(seconds=f * 0.1), f, 2, 3, y, of.get((r, f, y), [0, 0, 0]))
    for part in [*order, [36_000]]:
        df = spark.createDataFrame([row(r, f, y) for f in part for r in ("a", "b") for y in range(2)], schema)
        df.coalesce(1).write.mode("append").parquet(folder)
    zero = int(start.replace(tzinfo=dt.timezone.utc).timestamp())
    cycles = [
        (r, d, c, onset, chunk, zero + onset * 0.1, 0.1)
        for r in ("a", "b") for d, at in (("azi_fwd", 0), ("alt_fwd", 100)) for c, onset in enumerate(range(at, at + 100 - chunk, 16))
    ]
    w = spark.createDataFrame(cycles, "rec_id string, direction string, cycle int, onset_idx bigint, chunk bigint, start_sec double, frame_dur double")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream, w, of, cycles


def test_stream_cycles_are_whole_once_and_late_rows_go_aside(spark, tmp_path):
    import cmath

    # frames 5 and 60 are held back: 60 comes while its cycle is open, 5 long after its cycle was given out
    order = [[f for f in range(70) if f not in (5, 60)], [60, *range(70, 130)], [5, *range(130, 200)]]
    stream, w, of, cycles = movie_feed(spark, str(tmp_path / "feed"), order)
    t = stateful.run_to_table(stateful.stream_cycles(stream, stateful.cycle_ends(w), lateness_ms=2_000, side_ms=1_000_000), "append", by=["late"])
    late = t.filter("late").collect()
    assert {(r.rec_id, r.direction, r.cycle, r.frame_idx, r.y) for r in late} == {(r, "azi_fwd", 0, 5, y) for r in "ab" for y in (0, 1)}
    got = {(r.rec_id, r.direction, r.cycle, r.y): r for r in t.filter("NOT late").collect()}
    assert len(got) == t.filter("NOT late").count() == 2 * len(cycles)
    for rec, direction, cycle, onset, chunk, *_ in cycles:
        for y in range(2):
            r = got[(rec, direction, cycle, y)]
            told = [f for f in range(onset, onset + chunk) if f != 5]
            assert (r.n, r.chunk) == (len(told), chunk)
            for x in range(3):
                want = sum(of[(rec, f, y)][x] * cmath.exp(-2j * cmath.pi * (f - onset) / chunk) for f in told)
                assert r.re[x] == pytest.approx(want.real, abs=1e-6) and r.im[x] == pytest.approx(want.imag, abs=1e-6)


def test_stream_cycles_keep_no_state_behind_them(spark, tmp_path):
    stream, w, *_ = movie_feed(spark, str(tmp_path / "feed"), [range(0, 100), range(100, 200)])
    q = (
        stateful.stream_cycles(stream, stateful.cycle_ends(w), lateness_ms=2_000, side_ms=1_000_000).writeStream.format("memory").queryName("cycles_done")
        .outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    )
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) > 0 and held[-1] == 0


def test_late_rows_and_loss(spark):
    rows = [("a", 0, 100), ("a", 1, 300), ("a", 2, 150), ("b", 3, 40), ("a", 4, 301), ("a", 5, 290)]
    df = spark.createDataFrame(rows, "rec_id string, n bigint, t bigint")
    for block in (1, 2, 100):
        assert rows_of(windows.late_rows(df, "n", "t", 100, block), "n") == [(2,), (3,)]


def test_maps_are_replaced_per_recording_and_pruned(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([(r, y, 0, 1.0, 2.0) for r in ("a", "b") for y in range(2)], "rec_id string, y int, x int, v double, w double")
    lake.write_maps(df, path)
    lake.write_maps(df.filter("rec_id = 'b'").withColumn("v", F.lit(9.0)), path)
    got = {r.rec_id: r.v for r in lake.read_map(spark, path, "v").groupBy("rec_id").agg(F.max("v").alias("v")).collect()}
    assert got == {"a": 1.0, "b": 9.0}
    plan = lake.load_frames(spark, path, ["a"]).select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "rec_id" in plan and "w#" not in plan


def test_recordings_newest_first_and_folder_scan(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-02"), ("b", "2024-03-01"), ("c", "2023-01-01")], "rec_id string, created_at string")
    df.write.parquet(str(tmp_path / "cat"))
    assert [r.rec_id for r in lake.load_recordings(spark, str(tmp_path / "cat")).collect()] == ["b", "a", "c"]
    assert [r.rec_id for r in lake.library_recent(df, 2).collect()] == ["b", "a"]
    (tmp_path / "x.bin").write_bytes(b"123")
    assert [r.length for r in lake.scan_folder(spark, str(tmp_path), "*.bin").collect()] == [3]


def test_vacuous_comparison_is_not_agreement(spark):
    nan = float("nan")
    a = spark.createDataFrame([("n", 1, nan), ("k", 1, 1.0), ("m", 1, 1.0)], "rec_id string, y int, v double")
    b = spark.createDataFrame([("n", 1, nan), ("k", 1, 1.0 + 1e-15), ("m", 1, nan)], "rec_id string, y int, v double")
    tol = agree.Tolerance.relative(8).scaled(2.0)
    got = {r.rec_id: (r.vacuous, r.agrees, r.n_nan_mismatch) for r in agree.agreement(a, b, ["rec_id", "y"], "v", tol).collect()}
    assert got == {"n": (True, False, 0), "k": (False, True, 0), "m": (False, False, 1)}


def test_registry_is_complete(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 130 and len(o) > 110
    assert {"rec_id", "vfs"} <= set(e.entry(spark).columns)


def test_a_folder_of_part_files_is_streamed_like_one_file(spark, tmp_path):
    from phasemill.streaming import stateful

    spark.range(10).coalesce(2).write.parquet(str(tmp_path / "parts.parquet"))
    part = next((tmp_path / "parts.parquet").glob("*.parquet"))
    (tmp_path / "one.parquet").write_bytes(part.read_bytes())
    n = spark.read.parquet(str(tmp_path / "one.parquet")).count()
    assert stateful.run_to_table(stateful.stream_table(spark, str(tmp_path), "parts"), "append").count() == 10
    assert stateful.run_to_table(stateful.stream_table(spark, str(tmp_path), "one"), "append").count() == n


def test_migration_parses_every_text_once(spark):
    df = spark.createDataFrame([("a", '{"cortex": {"method": "k", "w": 2}, "odd": 1}'), ("b", "{}"), ("c", None)], "rec_id string, p string")
    stages = {"cortex": ("k", {"k": {"w": 1.0, "z": 3.0}}), "smoothing": ("g", {"g": {"s": 60.0}})}
    out = lake.migrate_params(df, "p", stages)
    got = {(r.rec_id, r.stage): (r.method, r.tunables, r.unknown) for r in out.collect()}
    assert got["a", "cortex"] == ("k", {"z": 3.0, "w": 2.0}, ["odd"]) and got["b", "smoothing"] == ("g", {"s": 60.0}, []) and len(got) == 6
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_json") + plan.lower().count("jsontostructs") <= 1 + 2 * len(stages)


def test_frames_of_a_recording_lie_in_few_files(spark, tmp_path):
    rows = spark.range(240).select((F.col("id") % 3).alias("rec_id"), F.col("id").alias("frame_idx"), F.lit(0).alias("y")).repartition(8)
    lake.write_frames(rows, str(tmp_path / "m"))
    got = lake.load_frames(spark, str(tmp_path / "m"))
    assert {(r.rec_id, r.frame_idx) for r in got.collect()} == {(i % 3, i) for i in range(240)}
    assert len(got.inputFiles()) <= 3 + 4  # recordings and ranges; a file per task and recording would be 24


def test_a_feed_in_thirds_is_written_by_several_tasks(spark, tmp_path):
    from phasemill.catalog.streams import _in_three

    seen = []

    def note(batch, number):
        r = batch.withColumn("f", F.input_file_name()).agg(F.min("id"), F.max("id"), F.count("id"), F.count_distinct("f")).first()
        seen.append(tuple(r))

    q = _in_three(spark, spark.range(90_000), "id").writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).foreachBatch(note).start()
    q.awaitTermination()
    assert [s[:3] for s in seen] == [(0, 29_999, 30_000), (30_000, 59_999, 30_000), (60_000, 89_999, 30_000)]
    assert {s[3] for s in seen} == {3}
