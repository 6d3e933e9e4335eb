"""Physical plans: exchanges and scans that must not creep in."""

import re

from pyspark.sql import functions as F

from phasemill.operators import morphology as mo
from phasemill.operators import project, refine, stencil
from phasemill.session import size_broadcasts_at_runtime


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, name, df):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def frame(spark, tmp_path):
    px = spark.range(200).selectExpr(
        "'a' AS rec_id", "10 AS height", "20 AS width", "CAST(id div 20 AS INT) AS y", "CAST(id % 20 AS INT) AS x", "rand(1) AS v", "rand(2) AS unused"
    )
    return stored(spark, tmp_path, "frame", px)


def test_separable_filter_shuffles_twice_and_prunes(spark, tmp_path):
    p = plan(stencil.gaussian_smooth(frame(spark, tmp_path), ["v"], 3.0))
    assert len(re.findall("Exchange hashpartitioning", p)) == 2
    assert "unused" not in p


def test_dilation_and_erosion_move_each_pixel_once_and_then_runs(spark, tmp_path):
    m = frame(spark, tmp_path).filter("v > 0.5")
    for p in (plan(mo.dilate(m, "disk", 15)), plan(mo.erode(m, "disk", 15))):
        # from below: the pixels go to their image row, the intervals of runs go to the rows they reach
        assert len(re.findall("Exchange hashpartitioning", p)) == 2
        assert "explode" not in p.split("Exchange hashpartitioning")[2]  # nothing is copied below the first


def test_rows_of_a_dilation_follow_runs_not_pixels(spark):
    full = spark.range(64 * 64).selectExpr("'a' AS rec_id", "94 AS height", "94 AS width", "CAST(15 + id div 64 AS INT) AS y", "CAST(15 + id % 64 AS INT) AS x")
    assert mo.runs(full).count() == 64
    spans = mo.spans_of("disk", 15)
    assert mo._shifted(full, spans, ["rec_id"], F.col("lo") + F.col("_s.a"), F.col("hi") + F.col("_s.b")).count() == 64 * 31
    corners = 2 * sum(64 + 2 * hi for dy, _, hi in spans if dy > 0)  # the rows above and below the square
    assert mo.dilate(full, "disk", 15).count() == 64 * 94 + corners


def test_gradient_shuffles_once_per_axis(spark, tmp_path):
    p = plan(stencil.gradient(frame(spark, tmp_path), ["v"]))
    assert len(re.findall("Exchange hashpartitioning", p)) == 2


def test_movie_pixels_are_scanned_once(spark, tmp_path):
    size_broadcasts_at_runtime(spark)
    rows = spark.range(400).selectExpr(
        "'a' AS rec_id", "id div 4 AS frame_idx", "(id div 4) * 0.1D AS ts_sec", "CAST(id % 4 AS INT) AS y", "4 AS height", "3 AS width",
        "array(1, 2, CAST(id AS INT)) AS pixels",
    )
    rows = stored(spark, tmp_path, "movie", rows)
    sweeps = spark.createDataFrame([("a", 0, "LR", 1.0, 2.0)], "rec_id string, sweep_idx int, label string, start_sec double, end_sec double")
    p = plan(project.one_scan_sums(rows, sweeps))
    reads = re.findall(r"ReadSchema: struct<([^\n]*)>", p)
    assert sum("pixels" in r for r in reads) == 1
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    heads = plan(project.frame_headers(rows))
    assert "PushedFilters: [IsNotNull(y), EqualTo(y,0)" in heads and "pixels" not in heads.split("ReadSchema")[1]
    # from the pixel scan up to the partial sums nothing is exchanged: the schedule comes to the movie
    base = project.with_floor(project.rowsums.row_baseline(project.one_scan_sums(rows, sweeps), "rest_mean")).cache()
    for df in (
        project.one_scan_sums(rows, sweeps), project.one_scan_sums(rows, sweeps, quality=True), project.one_scan_sums(rows, sweeps, True, "rest"),
        project.normalized_sums(rows, sweeps, base, "fractional", "half_wave", True),
    ):
        assert way_of_pixels(df) == ["MapInArrow", "Exchange", "MapInArrow"]
        assert "Generate" not in plan(df).split("MapInArrow")[-1].split("pixels")[0]


def way_of_pixels(df):
    """Exchanges and Python steps that the pixels pass on their way up."""
    lines = plan(df).split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "pixels" in line.split("ReadSchema")[-1])
    depth, way = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            depth = d
            way += [step for step in ("Exchange", "MapInArrow") if step in line]
    return way


def test_bucketed_movie_is_joined_in_place(spark, tmp_path, monkeypatch):
    import phasemill.session as session
    from phasemill.sources import lake

    size_broadcasts_at_runtime(spark)
    rows = spark.range(1024).selectExpr(
        "'a' AS rec_id", "id div 4 AS frame_idx", "(id div 4) * 0.1D AS ts_sec", "CAST(id % 4 AS INT) AS y", "4 AS height", "3 AS width",
        "array(1, 2, CAST(id AS INT)) AS pixels",
    )
    sweeps = spark.createDataFrame([("a", 0, "LR", 1.0, 2.0)], "rec_id string, sweep_idx int, label string, start_sec double, end_sec double")
    want = {str(r) for r in project.one_scan_sums(rows, sweeps).collect()}
    monkeypatch.setattr(session.join_small, "__defaults__", ("inner", -1))  # as if the schedule were large
    movie = lake.write_movie(rows, "movie_in_buckets", 4)
    try:
        df = project.one_scan_sums(movie, sweeps)
        assert way_of_pixels(df) == ["MapInArrow", "Exchange", "MapInArrow"]
        assert {str(r) for r in df.collect()} == want
    finally:
        spark.sql("DROP TABLE movie_in_buckets")


def test_hot_recording_is_spread(spark):
    from phasemill.operators import timebase

    hot = spark.range(200_000).selectExpr("'hot' AS rec_id", "id AS frame_idx", "id * 10000 AS hw_us", "id AS sys_us", "id AS seq")
    d = timebase.frame_deltas(hot.unionByName(hot.limit(100).withColumn("rec_id", F.lit("cold"))))
    assert "hashpartitioning(rec_id" in plan(d) and "_blk" in plan(d)
    assert d.agg(F.count("delta"), F.max("delta")).first()[:] == (200_098, 10_000)


def test_distance_in_a_wide_row_is_linear(spark):
    dims = spark.createDataFrame([("a", 2, 4096)], "rec_id string, height int, width int")
    marks = spark.createDataFrame([("a", 2, 4096, 0, 0), ("a", 2, 4096, 1, 3000)], "rec_id string, height int, width int, y int, x int")
    got = {(r.y, r.x): r.dist for r in mo.distance_to(marks, dims).collect()}
    assert len(got) == 8192
    for y, x in ((0, 0), (0, 1500), (1, 1499), (0, 4095), (1, 3000), (0, 3000)):
        assert got[y, x] == min((y * y + x * x) ** 0.5, ((y - 1) ** 2 + (x - 3000) ** 2) ** 0.5)


def test_greedy_pairs_are_sorted_once_and_grouped_by_numbers(spark, monkeypatch):
    size_broadcasts_at_runtime(spark)
    plans, cut = [], refine.cut
    monkeypatch.setattr(refine, "cut", lambda df: plans.append(plan(df)) or cut(df))
    # pairs that are there more than once, and more of them than a prefix of the order holds
    c = spark.range(3_000).selectExpr(
        "'r' AS rec_id", "CAST(id * 7919 % 1500 % 211 AS INT) AS a", "CAST(211 + id * 104729 % 1500 % 307 AS INT) AS b",
        "CAST(id * 31 % 97 AS DOUBLE) AS ratio", "CAST(-(id % 13) AS DOUBLE) AS neg_area",
    )
    want, used = set(), set()
    for r in sorted(c.collect(), key=lambda r: (r.ratio, r.neg_area, r.a, r.b)):
        if r.a not in used and r.b not in used:
            want.add((r.a, r.b))
            used |= {r.a, r.b}
    got = [(r.a, r.b) for r in refine.greedy_pairs(c, head=100).collect()]
    assert set(got) == want and len(got) == len(want)
    # a SortAggregate sorts what its task reads before anything moves, so its memory follows the size of a task's files
    assert plans and not any("SortAggregate" in p for p in plans)
    assert sum("rangepartitioning" in p for p in plans) == 1
