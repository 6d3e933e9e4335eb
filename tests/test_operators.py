"""Operators against brute force on small fixtures, with block sizes and limits forced down."""

import functools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasemill.operators import areas, blocks, manifest, quantiles, refine, stencil, telemetry, timebase
from phasemill.operators import components as cc
from phasemill.operators import morphology as mo

H, W = 12, 15


def mask_df(spark, m, rec="a"):
    h, w = m.shape
    rows = [(rec, h, w, int(y), int(x)) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "rec_id string, height int, width int, y int, x int")


def grid_df(spark, v, rec="a", name="v"):
    h, w = v.shape
    rows = [(rec, h, w, y, x, float(v[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, f"rec_id string, height int, width int, y int, x int, {name} double")


def to_mask(df, shape):
    out = np.zeros(shape, bool)
    for r in df.select("y", "x").collect():
        assert not out[r.y, r.x]
        out[r.y, r.x] = True
    return out


def rand_mask(seed, p=0.5, shape=(H, W)):
    return np.random.default_rng(seed).random(shape) < p


def brute_labels(m, conn):
    h, w = m.shape
    off = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if conn == 8 else [])
    lab, n = np.zeros(m.shape, int), 0
    for y in range(h):
        for x in range(w):
            if m[y, x] and not lab[y, x]:
                n += 1
                stack = [(y, x)]
                lab[y, x] = n
                while stack:
                    a, b = stack.pop()
                    for dy, dx in off:
                        c, d = a + dy, b + dx
                        if 0 <= c < h and 0 <= d < w and m[c, d] and not lab[c, d]:
                            lab[c, d] = n
                            stack.append((c, d))
    return lab


@pytest.mark.parametrize("conn,limit", [(4, 64), (8, 64), (4, 1), (8, 3)])
def test_components_in_one_tile_and_across_tiles(spark, conn, limit):
    m = rand_mask(conn + limit % 7)
    want = brute_labels(m, conn)
    got = np.zeros(m.shape, int)
    for r in cc.label_components(mask_df(spark, m), conn, tile_rows=limit).collect():
        got[r.y, r.x] = r.label
    assert (got == want).all()


def test_spiral_is_one_component(spark):
    m = np.zeros((9, 9), bool)
    m[0, :] = m[:, 8] = m[8, :] = m[2:, 0] = m[2, :7] = m[2:7, 6] = m[6, 2:7] = m[4:7, 2] = True
    n = cc.label_components(mask_df(spark, m), 4, tile_rows=1).agg(F.max("label")).first()[0]
    assert n == brute_labels(m, 4).max()


def test_all_set_is_one_and_largest_tie_takes_first(spark):
    assert cc.label_components(mask_df(spark, np.ones((6, 7), bool))).agg(F.max("label")).first()[0] == 1
    m = np.zeros((5, 9), bool)
    m[1:3, 1:3] = m[1:3, 6:8] = True
    assert to_mask(cc.largest_component(mask_df(spark, m)), m.shape)[:, :4].sum() == 4


def test_morphology_laws(spark):
    m = mask_df(spark, rand_mask(3))
    shape = (H, W)
    for kind in ("disk", "cross"):
        opened = to_mask(mo.opening(m, kind, 1), shape)
        again = to_mask(mo.opening(mo.opening(m, kind, 1), kind, 1), shape)
        assert (opened == again).all() and not (opened & ~rand_mask(3)).any()
    point = np.zeros((11, 11), bool)
    point[5, 5] = True
    d = to_mask(mo.dilate(mask_df(spark, point), "disk", 3), point.shape)
    yy, xx = np.ogrid[:11, :11]
    assert (d == ((yy - 5) ** 2 + (xx - 5) ** 2 <= 9)).all()
    closed = to_mask(mo.closing(m, "disk", 2), shape)
    assert not (rand_mask(3) & ~closed).any()


def brute_thin(m, first, second):
    a = np.pad(m, 1).astype(int)
    while True:
        before = a.copy()
        for codes in (first, second):
            gone = []
            for y, x in zip(*np.nonzero(a)):
                code = sum(a[y + dy, x + dx] * w for dy, dx, w in mo.RING_WEIGHTS)
                if code in codes:
                    gone.append((y, x))
            for y, x in gone:
                a[y, x] = 0
        if (a == before).all():
            return a[1:-1, 1:-1].astype(bool)


def test_skeletonize(spark):
    m = rand_mask(5, 0.75)
    codes = mo.thinning_codes()
    got = to_mask(mo.skeletonize(mask_df(spark, m)), m.shape)
    assert (got == brute_thin(m, *map(set, codes))).all()
    # a table of codes given by the caller is followed
    own = ([2, 8, 32, 128], [3, 6, 12])
    got = to_mask(mo.skeletonize(mask_df(spark, m), codes=own), m.shape)
    assert (got == brute_thin(m, *map(set, own))).all()


def test_skeletonize_across_bands(spark):
    """Frames taller than a band and blocks thicker than one round of sub-passes equal thinning in one piece."""
    rng = np.random.default_rng(4)
    m = rng.random((150, 90)) < 0.97
    m[20:120, 5:85] = True  # 100 pixels thick: several rounds, over two band borders
    thin = rng.random((140, 12)) < 0.6
    df = mask_df(spark, m).unionByName(mask_df(spark, thin).withColumn("rec_id", F.lit("thin")))
    got = mo.skeletonize(df)
    codes = [set(c) for c in mo.thinning_codes()]
    assert (to_mask(got.filter("rec_id <> 'thin'"), m.shape) == brute_thin(m, *codes)).all()
    assert (to_mask(got.filter("rec_id = 'thin'"), thin.shape) == brute_thin(thin, *codes)).all()
    assert mo.skeletonize(df.limit(0)).count() == 0


def test_distance_exact_and_empty(spark):
    m = rand_mask(8, 0.05)
    pts = np.argwhere(m)
    dims = spark.createDataFrame([("a", H, W), ("b", 2, 3)], "rec_id string, height int, width int")
    got = {(r.rec_id, r.y, r.x): r.dist for r in mo.distance_to(mask_df(spark, m), dims).collect()}
    for y in range(H):
        for x in range(W):
            assert got["a", y, x] == pytest.approx(math.sqrt(min((y - a) ** 2 + (x - b) ** 2 for a, b in pts)))
    assert all(math.isinf(v) for (rec, _, _), v in got.items() if rec == "b")


def test_fill_holes_labels_closed_gaps_only(spark, monkeypatch):
    """Masks of several densities against labelled backgrounds; what lies between far pixels is never spread."""
    masks = {f"m{i}": rand_mask(40 + i, p, (14, 17)) for i, p in enumerate((0.3, 0.5, 0.6, 0.7, 0.8, 0.9))}
    deep = np.zeros((14, 17), bool)  # a spiral: closed gaps that lead out by way of others
    deep[1:12, 1] = deep[11, 1:14] = deep[1, 3:14] = deep[1:12, 13] = deep[3:10, 3] = deep[9, 3:12] = deep[3:10, 11] = deep[3, 5:12] = True
    masks |= {"deep": deep, "none": np.eye(14, 17, dtype=bool)}
    df = functools.reduce(lambda a, b: a.union(b), [mask_df(spark, m, rec) for rec, m in masks.items()])
    got = {rec: np.zeros((14, 17), bool) for rec in masks}
    for r in mo.fill_holes(df).collect():
        assert not got[r.rec_id][r.y, r.x]
        got[r.rec_id][r.y, r.x] = True
    for rec, m in masks.items():
        lab = brute_labels(~m, 4)
        edge = {*lab[0], *lab[-1], *lab[:, 0], *lab[:, -1]}
        assert (got[rec] == (m | ((lab > 0) & ~np.isin(lab, list(edge))))).all(), rec
    spread, roots = [], cc.component_roots
    monkeypatch.setattr(cc, "component_roots", lambda px, *a, **k: spread.append(px.count()) or roots(px, *a, **k))
    far = [(5, 5), (5, 6), (5, 7), (6, 5), (6, 7), (7, 5), (7, 6), (7, 7), (700, 2), (7, 900), (700, 900)]
    px = spark.createDataFrame([("a", 1000, 1000, y, x) for y, x in far], df.schema)
    assert {(r.y, r.x) for r in mo.fill_holes(px).collect()} == {*far, (6, 6)}
    assert spread == [1]


def test_fill_holes_with_and_without_hole(spark):
    m = np.ones((6, 6), bool)
    m[2:4, 2:4] = False
    m[5, 3] = False
    got = to_mask(mo.fill_holes(mask_df(spark, m)), m.shape)
    assert got[2:4, 2:4].all() and not got[5, 3]


def test_gaussian_wider_than_frame(spark):
    v = np.random.default_rng(1).random((3, 4))
    k = stencil.gaussian_kernel(2.0)
    r = len(k) // 2

    def fold(i, n):
        while not 0 <= i < n:
            i = -1 - i if i < 0 else 2 * n - 1 - i
        return i

    one = np.array([[sum(w * v[fold(y + o, 3), x] for o, w in k) for x in range(4)] for y in range(3)])
    two = np.array([[sum(w * one[y, fold(x + o, 4)] for o, w in k) for x in range(4)] for y in range(3)])
    got = {(q.y, q.x): q.v for q in stencil.gaussian_smooth(grid_df(spark, v), ["v"], 2.0).collect()}
    assert r == 8
    assert all(got[y, x] == pytest.approx(two[y, x]) for y in range(3) for x in range(4))


def test_smoothing_stays_whole_under_repartitioning(spark):
    v = grid_df(spark, np.random.default_rng(2).random((H, W)))
    a = stencil.gaussian_smooth(v, ["v"], 1.5).agg(F.sum("v"), F.count("v")).first()
    b = stencil.gaussian_smooth(v.repartition(13, "x"), ["v"], 1.5).agg(F.sum("v"), F.count("v")).first()
    assert a[1] == b[1] == H * W and a[0] == pytest.approx(b[0])


def test_order_statistics_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "TALLY", 10)  # brackets are narrowed until they hold ten rows
    monkeypatch.setattr(quantiles, "BINS", 7)
    rng = random.Random(4)
    data = {"hot": [rng.gauss(0, 1) for _ in range(30_000)], "ties": [float(rng.randrange(3)) for _ in range(999)], "one": [5.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "rec_id string, v double")
    med = {r.rec_id: r.median for r in quantiles.median(df, ["rec_id"], "v").collect()}
    near = {r.rec_id: (r.lo, r.hi) for r in quantiles.nearest_rank(df, ["rec_id"], "v", {"lo": 0.02, "hi": 0.98}).collect()}
    for k, vs in data.items():
        s = sorted(vs)
        assert med[k] == pytest.approx(float(np.median(s)))
        pick = lambda p: s[math.floor(p * (len(s) - 1) + 0.5)]
        assert near[k] == (pick(0.02), pick(0.98))


def stamps(spark, n=200, seed=0):
    rng = random.Random(seed)
    rows, t, seq = [], 1_000_000, 0
    for i in range(n):
        t += rng.choice([9_000, 10_000, 10_000, 25_000])
        seq += rng.choice([1, 1, 1, 1, 2, 70 if i % 90 == 50 else 1])
        rows.append(("hot" if i % 3 else "cold", t, t + rng.randrange(300), seq))
    df = spark.createDataFrame(rows, "rec_id string, hw_us bigint, sys_us bigint, seq bigint")
    df = df.withColumn("_b", blocks.block_of("hw_us", 100_000))
    return blocks.index_rows(df, ["rec_id"], "_b", ["hw_us"], "frame_idx").drop("_b")


def test_blocked_windows_equal_plain_windows(spark):
    from pyspark.sql import Window

    s = stamps(spark)
    w = Window.partitionBy("rec_id").orderBy("frame_idx")
    plain = s.select("rec_id", "frame_idx", F.lag("hw_us", 3).over(w).alias("a"), F.lead("seq").over(w).alias("b"), F.sum("seq").over(w).alias("c"))
    n = blocks.neighbour_rows(
        s, ["rec_id"], "frame_idx", {"a": lambda v: F.lag("hw_us", 3).over(v), "b": lambda v: F.lead("seq").over(v)}, before=3, after=1, size=4
    )
    c = blocks.running_sum(n.withColumn("_b", blocks.block_of("frame_idx", 5)), ["rec_id"], "_b", ["frame_idx"], "seq", "c")
    assert c.select("rec_id", "frame_idx", "a", "b", "c").exceptAll(plain).count() == 0
    assert c.count() == plain.count() == 200


@pytest.mark.parametrize("bucket", [0.01, 0.05, 10.0])
def test_nearest_frame_any_bucket(spark, bucket):
    f = stamps(spark).select("rec_id", "frame_idx", (F.col("hw_us") / 1e6).alias("ts_sec"))
    rng = random.Random(9)
    on = [("hot", i, 0.5 + rng.random() * 4) for i in range(40)] + [("cold", i, 1.0 + i * 0.05) for i in range(40)]
    sw = spark.createDataFrame(on, "rec_id string, sweep_idx int, start_sec double")
    got = {(r.rec_id, r.sweep_idx): r.onset_idx for r in timebase.nearest_frame(sw, f, bucket).collect()}
    fr = {}
    for r in f.collect():
        fr.setdefault(r.rec_id, []).append((r.frame_idx, r.ts_sec))
    for rec, i, t in on:
        assert got[rec, i] == min(fr[rec], key=lambda p: (abs(p[1] - t), p[0]))[0]


def test_exact_tie_and_equal_stamps(spark):
    f = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 9.0)], "rec_id string, frame_idx bigint, ts_sec double")
    sw = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 3.0), ("a", 2, 6.0), ("a", 3, 99.0)], "rec_id string, sweep_idx int, start_sec double")
    got = {r.sweep_idx: r.onset_idx for r in timebase.nearest_frame(sw, f, 2.5).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3}


def test_capture_quality_counts(spark):
    def rec(name, steps, seqs):
        t, s, rows = 0, 100, []
        for i, (dt, ds) in enumerate(zip(steps, seqs)):
            t, s = t + dt, s + ds
            rows.append((name, i, t, t, s))
        return rows

    n = 100
    rows = rec("clean", [10_000] * n, [1] * n) + rec("gap1", [10_000] * n, [1] * 50 + [2] + [1] * 49)
    rows += rec("gap3", [10_000] * n, [1] * 50 + [4] + [1] * 49) + rec("stall", [10_000] * 60 + [40_000] + [10_000] * 39, [1] * n)
    rows += rec("jitter", [6_000, 14_000] * 50, [1] * n) + [("lone", 0, 5, 5, 1)]
    f = spark.createDataFrame(rows, "rec_id string, frame_idx bigint, hw_us bigint, sys_us bigint, seq bigint")
    q = {r.rec_id: r for r in telemetry.capture_quality(f, 2.0, 5, 0.1).collect()}
    assert q["clean"].passed and q["clean"].mean_fps == pytest.approx(100.0)
    assert [q[k].sequence_drops for k in ("clean", "gap1", "gap3", "stall")] == [0, 1, 3, 0]
    assert q["stall"].timing_anomalies == 1 and not q["stall"].passed
    assert q["jitter"].failures == ["jitter"]
    assert q["lone"].failures == ["too few frames"]


def test_clock_drift_survives_midnight(spark):
    day = timebase.DAY_US
    rows = [("a", i, day - 500_000 + i * 10_000 + 7_000 + i, (day - 500_000 + i * 10_000) % day) for i in range(100)]
    f = spark.createDataFrame(rows, "rec_id string, frame_idx bigint, sys_us bigint, hw_us bigint")
    r = timebase.clock_drift(f).first()
    assert (r.start_us, r.end_us, r.drift_us) == (7_000, 7_099, 99)


def test_greedy_pairs_equals_sequential(spark):
    rng = random.Random(3)
    c = {(min(a, b), max(a, b)): (round(rng.random(), 1), -rng.randrange(3)) for a, b in (rng.sample(range(12), 2) for _ in range(40))}
    df = spark.createDataFrame([("r", a, b, q, float(n)) for (a, b), (q, n) in c.items()], "rec_id string, a int, b int, ratio double, neg_area double")
    want, used = set(), set()
    for _, _, a, b in sorted((q, n, a, b) for (a, b), (q, n) in c.items()):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    assert {(r.a, r.b) for r in refine.greedy_pairs(df).collect()} == want
    # rounds that settle three pairs in order, then the leaders, give the same
    assert {(r.a, r.b) for r in refine.greedy_pairs(df, head=3).collect()} == want
    assert refine.greedy_pairs(df.limit(0)).count() == 0


def test_greedy_pairs_along_a_path(spark):
    """10,000 pairs of which each waits for the one before it: one round."""
    df = spark.range(10_000).selectExpr("'r' AS rec_id", "id AS a", "id + 1 AS b", "double(id) AS ratio", "0.0D AS neg_area")
    got = sorted(r.a for r in refine.greedy_pairs(df).collect())
    assert got == list(range(0, 10_000, 2))


def test_flooding_covers_the_mask_and_keeps_minimax_levels(spark):
    v = np.random.default_rng(6).integers(0, 5, (H, W)).astype(float)
    df = grid_df(spark, v).withColumn("m", F.expr("CASE WHEN y = 1 AND x = 1 THEN 1 WHEN y = 9 AND x = 12 THEN 2 ELSE 0 END"))
    got = {(r.y, r.x): r for r in refine.basin_assign(df, "v", "m").collect()}
    level = np.full((H, W), np.inf)
    level[1, 1], level[9, 12] = v[1, 1], v[9, 12]
    for _ in range(H * W):
        p = np.pad(level, 1, constant_values=np.inf)
        best = np.min([p[1 + a : 1 + a + H, 1 + b : 1 + b + W] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        level = np.minimum(level, np.maximum(best, v))
    assert all(got[y, x].level == level[y, x] and got[y, x].basin in (1, 2) for y in range(H) for x in range(W))
    for k in (1, 2):
        m = np.array([[got[y, x].basin == k for x in range(W)] for y in range(H)])
        assert brute_labels(m, 8).max() == 1


def queue_flood(v, seeds, conn):
    """Ordered flooding with a queue: (level, age) decides whose turn it is."""
    import heapq

    label, level, age = {}, {}, 0
    heap = []
    for (y, x), lab in seeds.items():
        label[y, x], level[y, x] = lab, v[y, x]
        heapq.heappush(heap, (v[y, x], age, y, x))
        age += 1
    ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (conn == 8 or not (a and b))]
    while heap:
        at, _, y, x = heapq.heappop(heap)
        for a, b in ring:
            c, d = y + a, x + b
            if 0 <= c < v.shape[0] and 0 <= d < v.shape[1] and (c, d) not in label:
                label[c, d], level[c, d] = label[y, x], max(at, v[c, d])
                heapq.heappush(heap, (level[c, d], age, c, d))
                age += 1
    return label, level


@pytest.mark.parametrize("conn", [4, 8])
def test_flooding_equals_an_ordered_queue_on_sloped_ground(spark, conn):
    v = np.random.default_rng(conn).permutation(H * W).reshape(H, W).astype(float)  # no two equal heights
    seeds = {(1, 1): 1, (9, 12): 2, (4, 7): 3}
    cases = " ".join(f"WHEN y = {y} AND x = {x} THEN {k}" for (y, x), k in seeds.items())
    df = grid_df(spark, v).withColumn("m", F.expr(f"CASE {cases} ELSE 0 END"))
    got = {(r.y, r.x): r for r in refine.basin_assign(df, "v", "m", conn).collect()}
    label, level = queue_flood(v, seeds, conn)
    assert {k: r.level for k, r in got.items()} == level
    for k in (1, 2, 3):  # every basin hangs together
        m = np.array([[got[y, x].basin == k for x in range(W)] for y in range(H)])
        assert brute_labels(m, conn).max() == 1
    # pixels flooded below the level of their basin's rim follow a turn order that counts steps, not pushes;
    # everywhere else the first front owns the pixel
    same = np.mean([got[k].basin == label[k] for k in label])
    assert same > 0.97


def test_a_front_that_was_given_up_owns_nothing(spark):
    v = np.full((6, 4), np.nan)
    v[0] = [0, 9, 1, 10]
    v[1:5, 2] = 5
    v[5, 2] = 0
    df = grid_df(spark, v).filter("NOT isnan(v)")
    df = df.withColumn("m", F.expr("CASE WHEN y = 0 AND x = 0 THEN 1 WHEN y = 5 THEN 2 ELSE 0 END"))
    got = {(r.y, r.x): r.basin for r in refine.basin_assign(df, "v", "m", 4).collect()}
    assert got[0, 2] == 2 and got[0, 3] == 2 and got[0, 0] == 1


def test_a_recording_of_many_patches_is_refined(spark):
    m = np.zeros((45, 60), bool)
    m[::3, ::4] = m[::3, 1::4] = m[1::3, ::4] = True  # 225 patches of three pixels
    sig = grid_df(spark, np.where(m, 1.0, 0.0), name="vfs_smooth")
    px = areas.extract_patches(mask_df(spark, m), sig, open_n=0, close_n=0, dilation=0, min_px=4)
    assert px.count() == 0
    px = areas.extract_patches(mask_df(spark, m), sig, open_n=0, close_n=0, dilation=0, min_px=1, border_width=2)
    assert px.select("patch").distinct().count() == 225
    few = areas.extract_patches(mask_df(spark, m), sig, open_n=0, close_n=0, dilation=0, min_px=1, border_width=1)
    kept = areas.extract_patches(mask_df(spark, m), sig, open_n=0, close_n=0, dilation=0, min_px=1, border_width=1, noise_limit=100)
    assert few.count() <= kept.count() == 3 * 225


def test_cluster_without_a_shared_folder_is_refused():
    from phasemill.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_flooding_meets_a_wall(spark):
    v = np.zeros((5, 9))
    v[:, 4] = 3.0
    df = grid_df(spark, v).withColumn("m", F.expr("CASE WHEN y = 2 AND x = 0 THEN 1 WHEN y = 2 AND x = 8 THEN 2 ELSE 0 END"))
    got = {(r.y, r.x): r.basin for r in refine.basin_assign(df, "v", "m").collect()}
    assert all(b == (1 if x < 4 else 2) for (y, x), b in got.items() if x != 4)


def test_impose_minima_leaves_only_the_marked(spark):
    v = np.random.default_rng(7).random((8, 8))
    df = grid_df(spark, v).withColumn("at", F.expr("(y = 1 AND x = 1) OR (y = 6 AND x = 5)"))
    out = refine.impose_minima(df, "v", "at")
    low = {(r.y, r.x) for r in refine.regional_minima(out, "level").collect()}
    assert low == {(1, 1), (6, 5)}


def test_coverage_against_loops(spark):
    rng = np.random.default_rng(11)
    yy, xx = np.mgrid[:10, :10]
    azi, alt, jac = xx * 1.3, yy * 1.2 - 3, rng.normal(0.4, 1, (10, 10))
    rows = [("a", 1, 10, 10, int(y), int(x), float(azi[y, x]), float(alt[y, x]), float(jac[y, x])) for y in range(10) for x in range(10)]
    df = spark.createDataFrame(rows, "rec_id string, patch int, height int, width int, y int, x int, azi double, alt double, jac double")
    s, _ = refine.coverage(df, "azi", "alt", "jac", 2.0)
    r = s.first()
    sg = np.sign(jac.mean())
    keep = np.sign(jac) == sg
    assert r.jac_coverage == pytest.approx(np.abs(jac[keep]).sum() / 4)
    g = np.zeros((181, 181), bool)
    half = lambda a: int(math.floor(abs(a) + 0.5) * (1 if a >= 0 else -1))
    for y, x in zip(*np.nonzero(keep)):
        g[half(alt[y, x]) + 90, half(azi[y, x]) + 90] = True

    def fill(m):
        lab = brute_labels(~m, 4)
        edge = set(lab[0]) | set(lab[-1]) | set(lab[:, 0]) | set(lab[:, -1])
        return m | ((lab > 0) & ~np.isin(lab, list(edge)))

    def shift(m, d):
        return np.pad(m, 1)[1 + d[0] : 182 + d[0], 1 + d[1] : 182 + d[1]]

    cross = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    g = fill(g)
    dil = np.any([shift(g, d) for d in cross], axis=0)
    g = fill(np.all([shift(dil, d) for d in cross], axis=0))
    assert r.actual_coverage == g.sum() and r.n_outside == 0
    far = df.withColumn("alt", F.when(F.col("y") == 0, 200.0).when(F.col("y") == 1, float("nan")).otherwise(F.col("alt")))
    assert refine.coverage(far, "azi", "alt", "jac", 2.0)[0].first().n_outside == keep[:2].sum()


def test_adjacency_refuses_degenerate_width(spark):
    with pytest.raises(ValueError):
        areas.adjacent_patches(mask_df(spark, np.ones((2, 2), bool)).withColumn("patch", F.lit(1)), 1)


def test_stale_stages_follow_one_edit(spark):
    base = {p: "x" for p in manifest.PARAMETERS}
    cases = {
        "none": (base, []),
        "eccentricity": (base | {"eccentricity": "y"}, ["eccentricity"]),
        "refine": (base | {"patch_refinement": "y"}, ["patch_refinement", "patch_extraction", "labels", "eccentricity", "derived_maps"]),
        "raw": (base | {"raw_identity": "y"}, list(manifest.STAGES)),
    }
    # an edit of the refinement leaves the extraction's key alone, but its result is not stored
    new = spark.createDataFrame([{"rec_id": k, **v} for k, (v, _) in cases.items()])
    old = spark.createDataFrame([{"rec_id": k, **base} for k in cases])
    f_new, f_old = manifest.stage_fingerprints(new), manifest.stage_fingerprints(old)
    runs = {}
    for r in manifest.stale_stages(f_new, f_old, f_old.select("rec_id", "stage")).filter("runs").collect():
        runs.setdefault(r.rec_id, set()).add(r.stage)
    assert {k: runs.get(k, set()) for k in cases} == {k: set(v) for k, (_, v) in cases.items()}


def test_refresh_replaces_only_stale_recordings(spark, tmp_path):
    path = str(tmp_path / "maps")
    data = spark.createDataFrame([(r, y, 0, 1.0) for r in ("a", "b") for y in range(3)], "rec_id string, y int, x int, v double")
    everything = data.select("rec_id").distinct().withColumn("stage", F.lit("labels")).withColumn("runs", F.lit(True))
    manifest.refresh(everything, data, lambda d: d, path)
    manifest.refresh(everything.withColumn("runs", F.col("rec_id") == "b"), data, lambda d: d.withColumn("v", F.lit(2.0)), path)
    got = {r.rec_id: r.v for r in spark.read.parquet(path).groupBy("rec_id").agg(F.max("v").alias("v")).collect()}
    assert got == {"a": 1.0, "b": 2.0}


def _cut_frame(spark):
    """A frame of 4 x 5 of which only the first 13 pixels exist, and a whole one."""
    import random

    r = random.Random(7)
    px = [(rec, 4, 5, i // 5, i % 5, r.uniform(-1, 1)) for rec, n in (("whole", 20), ("cut", 13)) for i in range(n)]
    return spark.createDataFrame(px, "rec_id string, height int, width int, y int, x int, v double")


def test_stencils_give_no_pixels_that_a_frame_does_not_have(spark):
    from phasemill.operators import stencil

    df = _cut_frame(spark)
    at = {(r.rec_id, r.y, r.x): r.v for r in df.collect()}
    assert {(r.rec_id, r.y, r.x) for r in stencil.gaussian_smooth(df, ["v"], 1.0).collect()} == set(at)
    got = {(r.rec_id, r.y, r.x): r.v for r in stencil.box_filter(df, ["v"], 4).collect()}
    assert set(got) == set(at)

    def mirrored(i, n):
        return -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i

    one = {(k, y, x): sum(at.get((k, mirrored(y + o, 4), x), 0.0) / 4 for o in range(-2, 2)) for k, y, x in at}
    want = {(k, y, x): sum(one.get((k, y, mirrored(x + o, 5)), 0.0) / 4 for o in range(-2, 2)) for k, y, x in at}
    assert max(abs(got[p] - want[p]) for p in at) < 1e-12


def test_neighbour_sums_of_a_frame_with_missing_pixels(spark):
    from phasemill.operators import stencil

    df = _cut_frame(spark)
    at = {(r.rec_id, r.y, r.x): r.v for r in df.collect()}
    offs = [(-1, 0, 0.5), (2, -1, 0.25)]  # without the pixel itself
    for border in ("drop", "one"):
        got = {(r.rec_id, r.y, r.x): r.n_sum for r in stencil.neighbours(df, "v", offs, border).collect()}
        gap = 1.0 if border == "one" else 0.0
        want = {(k, y, x): sum(w * at.get((k, y + a, x + b), gap) for a, b, w in offs) for k, y, x in at}
        assert set(got) == set(at) and max(abs(got[p] - want[p]) for p in at) < 1e-12


def test_equal_distances_from_a_centroid_tie(spark):
    from fractions import Fraction as Q

    from phasemill.operators import stats

    # the nearest pixels are equally far from the centroid, which its last bits do not show
    spots = [(2, 6), (3, 3), (4, 3), (4, 6), (5, 4)]
    px = [("r", 6, 8, y, x, 1) for y, x in spots]
    df = spark.createDataFrame(px, "rec_id string, height int, width int, y int, x int, label int")
    n = len(spots)
    cy, cx = Q(sum(y for y, _ in spots), n), Q(sum(x for _, x in spots), n)
    for ties, order in (("row", lambda p: p), ("col", lambda p: p[::-1])):
        want = min(spots, key=lambda p: ((p[0] - cy) ** 2 + (p[1] - cx) ** 2, order(p)))
        assert tuple(stats.patch_centroid_snap(df, ties=ties).first()[2:]) == want


def test_components_of_keys_that_are_called_like_edges(spark):
    from phasemill.operators import components

    df = _cut_frame(spark).filter("v > 0").withColumnsRenamed({"rec_id": "a"}).withColumn("b", F.lit(1))
    for conn in (4, 8):
        want = components.component_roots(df.withColumnsRenamed({"a": "k", "b": "l"}), conn, ["k", "l"])
        got = components.component_roots(df, conn, ["a", "b"])
        assert {tuple(r) for r in got.select("a", "b", "y", "x", "root").collect()} == {tuple(r) for r in want.select("k", "l", "y", "x", "root").collect()}
