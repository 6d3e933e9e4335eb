"""Queries over minima, flooding, coverage and refinement."""

from pyspark.sql import functions as F

from phasemill.catalog import sqlmask as sm
from phasemill.catalog.registry import query
from phasemill.catalog.regions import SMOOTH, smooth
from phasemill.functions.columns import r6
from phasemill.operators import areas, refine, stencil
from phasemill.operators.stencil import box3, cross
from phasemill.sources import views

PX = ["rec_id", "y", "x"]

_STEP = "(SELECT rec_id, height, width, y, x, round(v, 1) AS e FROM v_raster)"


def _stepped(spark, d):
    """A terraced surface: rounding makes plateaus."""
    return views.raster(spark, d).withColumn("e", F.round("v", 1)).select("rec_id", "height", "width", "y", "x", "e", "v", "label")


@query(
    "regional_minima",
    f"""WITH s AS MATERIALIZED {_STEP}, z AS MATERIALIZED (SELECT * FROM {sm.roots("s", 8, "rec_id", "e")}),
        n AS (SELECT rec_id, y, x, min(e) AS low FROM ({sm.scatter("s", box3(), "p.e")}) GROUP BY ALL)
        SELECT rec_id, y, x FROM (SELECT z.rec_id, z.y, z.x, bool_or(low < e) OVER (PARTITION BY z.rec_id, root) AS down FROM z JOIN n USING (rec_id, y, x)) WHERE NOT down""",
    "v_raster",
)
def _(spark, d):
    return refine.regional_minima(_stepped(spark, d), "e").select(*PX)


@query(
    "progressive_minima",
    f"""WITH b AS (SELECT rec_id, min(v) - 0.05 AS s, CAST(floor((max(v) + 0.05 - (min(v) - 0.05)) / 0.05 + 1e-9) AS BIGINT) AS n FROM v_raster GROUP BY rec_id),
        c AS MATERIALIZED (SELECT r.rec_id, k, height, width, y, x FROM v_raster r JOIN b USING (rec_id), range(100) t(k) WHERE k <= n AND (v - s) / 0.05 - 1e-9 <= k),
        l AS MATERIALIZED (SELECT * FROM {sm.roots("c", 4, "rec_id, k")}),
        p AS (SELECT rec_id, coalesce(min(k) FILTER (WHERE m >= 2), max(k)) AS k FROM (SELECT rec_id, k, count(DISTINCT root) AS m FROM l GROUP BY ALL) GROUP BY rec_id)
        SELECT rec_id, y, x, CAST(dense_rank() OVER (PARTITION BY rec_id ORDER BY root) AS INTEGER) AS label FROM l JOIN p USING (rec_id, k)""",
    "v_raster",
)
def _(spark, d):
    return refine.progressive_minima(views.raster(spark, d), "v", 0.05).select(*PX, "label")


@query(
    "flood_level",
    """WITH RECURSIVE e AS MATERIALIZED (SELECT rec_id, y, x, round(v, 1) AS e, w > 0.2 AS seed FROM v_raster),
       f(rec_id, y, x, e, l) AS (SELECT rec_id, y, x, e, e FROM e WHERE seed
         UNION SELECT q.rec_id, q.y, q.x, q.e, greatest(f.l, q.e) FROM f JOIN e q ON q.rec_id = f.rec_id AND abs(q.y - f.y) <= 1 AND abs(q.x - f.x) <= 1)
       SELECT rec_id, e.y, e.x, round(min(l), 6) + 0.0 AS level FROM e LEFT JOIN f USING (rec_id, y, x) GROUP BY rec_id, e.y, e.x""",
    "v_raster",
)
def _(spark, d):
    # the level at which a front arrives is the minimax path cost, whatever the tie-breaks
    r = views.raster(spark, d).withColumn("e", F.round("v", 1))
    seeds = r.withColumn("m", F.when(F.col("w") > 0.2, F.col("y") * 25 + F.col("x") + 1).otherwise(0))
    b = refine.basin_assign(seeds, "e", "m")
    return b.select(*PX, r6("level").alias("level"))


def _basins(source: str, conn: int) -> str:
    """Tables t (level, steps) and b (basin): levels, then steps since the level last rose, then the neighbour whose turn came first."""
    def near(p: str, q: str) -> str:
        dy, dx = f"abs({p}.y - {q}.y)", f"abs({p}.x - {q}.x)"
        return f"{dy} <= 1 AND {dx} <= 1" if conn == 8 else f"{dy} + {dx} <= 1"

    return f"""e AS MATERIALIZED ({source}),
       f(rec_id, y, x, l) AS (SELECT rec_id, y, x, v FROM e WHERE seed IS NOT NULL
         UNION SELECT q.rec_id, q.y, q.x, greatest(f.l, q.v) FROM f JOIN e q ON q.rec_id = f.rec_id AND {near('q', 'f')}),
       p AS MATERIALIZED (SELECT e.*, l FROM e JOIN (SELECT rec_id, y, x, min(l) AS l FROM f GROUP BY ALL) USING (rec_id, y, x)),
       n AS MATERIALIZED (SELECT a.rec_id, a.y, a.x, a.seed, a.v, a.l, b.y AS ny, b.x AS nx, b.l AS nl FROM p a JOIN p b
         ON a.rec_id = b.rec_id AND {near('a', 'b')} AND (a.y <> b.y OR a.x <> b.x)),
       z AS MATERIALIZED (SELECT rec_id, y, x FROM n GROUP BY rec_id, y, x, seed, v HAVING seed IS NOT NULL OR min(nl) < v),
       size AS (SELECT rec_id, count(*) AS n FROM e GROUP BY rec_id),
       h(rec_id, y, x, l, h) AS (SELECT rec_id, y, x, l, 0 FROM p SEMI JOIN z USING (rec_id, y, x)
         UNION SELECT n.rec_id, n.y, n.x, n.l, h.h + 1 FROM h JOIN n ON n.rec_id = h.rec_id AND n.ny = h.y AND n.nx = h.x AND n.l = h.l JOIN size ON size.rec_id = h.rec_id
         ANTI JOIN z ON z.rec_id = n.rec_id AND z.y = n.y AND z.x = n.x WHERE h.h < size.n),
       t AS MATERIALIZED (SELECT rec_id, y, x, l, min(h) AS h FROM h GROUP BY ALL),
       up AS MATERIALIZED (SELECT n.rec_id, n.y, n.x, arg_min(struct_pack(y := t.y, x := t.x), struct_pack(l := t.l, h := t.h, y := t.y, x := t.x)) AS u FROM n
         JOIN t ON t.rec_id = n.rec_id AND t.y = n.ny AND t.x = n.nx WHERE n.seed IS NULL GROUP BY ALL),
       b(rec_id, y, x, basin) AS (SELECT rec_id, y, x, seed FROM e WHERE seed IS NOT NULL
         UNION ALL SELECT up.rec_id, up.y, up.x, b.basin FROM b JOIN up ON up.rec_id = b.rec_id AND up.u.y = b.y AND up.u.x = b.x)"""


_SEEDED = "SELECT rec_id, y, x, v, CASE WHEN w > 0.2 THEN y * 25 + x + 1 END AS seed FROM v_raster"
_BASINS = f"WITH RECURSIVE {_basins(_SEEDED, 8)} SELECT rec_id, y, x, CAST(basin AS BIGINT) AS basin FROM e LEFT JOIN b USING (rec_id, y, x)"


@query("basin_assign", _BASINS, "v_raster")
def _(spark, d):
    r = views.raster(spark, d).withColumn("m", F.when(F.col("w") > 0.2, F.col("y") * 25 + F.col("x") + 1).otherwise(0))
    return refine.basin_assign(r, "v", "m").select(*PX, "basin")


def _divides(surface: str) -> str:
    """The SQL twin of `basin_lines` over a surface (rec_id, height, width, y, x, e)."""
    minima = f"""s AS MATERIALIZED {surface}, zone AS MATERIALIZED (SELECT * FROM {sm.roots("s", 4, "rec_id", "e")}),
        low AS (SELECT rec_id, y, x, min(e) AS low FROM ({sm.scatter("s", cross(1), "p.e")}) GROUP BY ALL),
        mins AS MATERIALIZED (SELECT rec_id, height, width, y, x FROM
          (SELECT zone.*, bool_or(low < e) OVER (PARTITION BY zone.rec_id, root) AS down FROM zone JOIN low USING (rec_id, y, x)) WHERE NOT down)"""
    seeded = f"SELECT s.rec_id, s.y, s.x, s.e AS v, m.label AS seed FROM s LEFT JOIN {sm.labels('mins', 4, 'col')} m USING (rec_id, y, x)"
    return f"""WITH RECURSIVE {minima}, {_basins(seeded, 4)},
       d AS MATERIALIZED (SELECT t.*, b.basin FROM t JOIN b USING (rec_id, y, x)),
       line AS (SELECT q.rec_id, q.y, q.x FROM d q JOIN d o ON o.rec_id = q.rec_id AND abs(o.y - q.y) + abs(o.x - q.x) = 1
         WHERE (o.l, o.h, o.y, o.x) < (q.l, q.h, q.y, q.x) GROUP BY ALL HAVING min(o.basin) <> max(o.basin))
       SELECT rec_id, y, x, CASE WHEN line.rec_id IS NULL THEN CAST(basin AS BIGINT) ELSE 0 END AS basin FROM d LEFT JOIN line USING (rec_id, y, x)"""


@query("basin_divides", _divides(_STEP), "v_raster")
def _(spark, d):
    return refine.basin_lines(_stepped(spark, d), "e").select(*PX, F.col("basin").cast("bigint").alias("basin"))


@query("basin_lines", _divides(f"(SELECT rec_id, height, width, y, x, v AS e FROM ({SMOOTH}))"), "v_raster")
def _(spark, d):
    return refine.basin_lines(smooth(spark, d), "vfs_smooth").select(*PX, F.col("basin").cast("bigint").alias("basin"))


@query(
    "reconstruct_erosion",
    """WITH RECURSIVE e AS MATERIALIZED (SELECT rec_id, y, x, round(v, 1) AS m, CASE WHEN w > 0.1 THEN round(v, 1) ELSE 9.0 END AS k FROM v_raster),
       f(rec_id, y, x, m, l) AS (SELECT rec_id, y, x, m, greatest(k, m) FROM e WHERE k < 9
         UNION SELECT q.rec_id, q.y, q.x, q.m, greatest(f.l, q.m) FROM f JOIN e q ON q.rec_id = f.rec_id AND abs(q.y - f.y) <= 1 AND abs(q.x - f.x) <= 1)
       SELECT rec_id, y, x, round(min(l), 6) + 0.0 AS level FROM f GROUP BY rec_id, y, x""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d).withColumn("m", F.round("v", 1))
    r = r.withColumn("k", F.when(F.col("w") > 0.1, F.col("m")).otherwise(9.0))
    return refine.reconstruct_erosion(r, "k", "m").select(*PX, r6("level").alias("level"))


@query(
    "impose_minima",
    """WITH RECURSIVE d AS (SELECT rec_id, (max(v) - min(v)) / 1000.0 AS d FROM v_raster GROUP BY rec_id),
       e AS MATERIALIZED (SELECT rec_id, y, x, w > 0.25 AS seed, CASE WHEN w > 0.25 THEN CAST('-inf' AS DOUBLE) ELSE v + d END AS m FROM v_raster JOIN d USING (rec_id)),
       f(rec_id, y, x, l) AS (SELECT rec_id, y, x, m FROM e WHERE seed
         UNION SELECT q.rec_id, q.y, q.x, greatest(f.l, q.m) FROM f JOIN e q ON q.rec_id = f.rec_id AND abs(q.y - f.y) <= 1 AND abs(q.x - f.x) <= 1)
       SELECT rec_id, e.y, e.x, coalesce(min(l), CAST('inf' AS DOUBLE)) AS level FROM e LEFT JOIN f USING (rec_id, y, x) GROUP BY rec_id, e.y, e.x""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d).withColumn("at", F.col("w") > 0.25)
    return refine.impose_minima(r, "v", "at").select(*PX, F.col("level"))


_PATCH = "rec_id, patch"


def _fill_box(src: str) -> str:
    """Holes filled inside the box around the pixels; outside it nothing blocks the way to the frame's edge."""
    box = f"SELECT {_PATCH}, height, width, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM {src} GROUP BY ALL"
    rows = f"SELECT *, CAST(unnest(range(y0, y1 + 1)) AS INTEGER) AS y FROM ({box})"
    cells = f"SELECT *, CAST(unnest(range(x0, x1 + 1)) AS INTEGER) AS x FROM ({rows})"
    return (
        f"(WITH RECURSIVE cell AS MATERIALIZED (SELECT c.* FROM ({cells}) c ANTI JOIN {src} m ON m.rec_id = c.rec_id AND m.patch = c.patch AND m.y = c.y AND m.x = c.x), "
        f"air AS (SELECT {_PATCH}, y, x FROM cell WHERE y IN (y0, y1) OR x IN (x0, x1) "
        "UNION SELECT c.rec_id, c.patch, c.y, c.x FROM air r JOIN cell c ON c.rec_id = r.rec_id AND c.patch = r.patch AND abs(c.y - r.y) + abs(c.x - r.x) = 1) "
        f"SELECT {_PATCH}, height, width, y, x FROM {src} UNION ALL SELECT c.rec_id, c.patch, c.height, c.width, c.y, c.x FROM cell c "
        "ANTI JOIN air r ON c.rec_id = r.rec_id AND c.patch = r.patch AND c.y = r.y AND c.x = r.x)"
    )


@query(
    "coverage",
    f"""WITH p AS MATERIALIZED (SELECT *, avg(v) OVER (PARTITION BY rec_id, label) AS mj FROM v_raster WHERE label > 0),
        k AS MATERIALIZED (SELECT rec_id, label AS patch, abs(v) / 4 AS share, CAST(round(alt) AS INTEGER) + 90 AS y, CAST(round(azi) AS INTEGER) + 90 AS x
          FROM p WHERE sign(v) = sign(mj) AND v <> 0),
        c AS MATERIALIZED (SELECT DISTINCT rec_id, patch, 181 AS height, 181 AS width, y, x FROM k WHERE y BETWEEN 0 AND 180 AND x BETWEEN 0 AND 180),
        a AS MATERIALIZED (SELECT * FROM {_fill_box("c")}), b AS MATERIALIZED (SELECT * FROM {sm.erode(sm.dilate("a", cross(1), _PATCH), cross(1), False, _PATCH)}),
        f AS MATERIALIZED (SELECT * FROM {_fill_box("b")}), n AS (SELECT rec_id, patch, count(*) AS n FROM f GROUP BY ALL),
        s AS (SELECT rec_id, patch, sum(share) AS share, count(*) FILTER (WHERE NOT (y BETWEEN 0 AND 180 AND x BETWEEN 0 AND 180)) AS n_outside FROM k GROUP BY ALL)
        SELECT d.rec_id, d.patch, round(coalesce(share, 0), 6) + 0.0 AS jac_coverage, CAST(coalesce(n, 0) AS DOUBLE) AS actual_coverage, coalesce(n_outside, 0) AS n_outside
        FROM (SELECT DISTINCT rec_id, label AS patch FROM p) d LEFT JOIN s USING (rec_id, patch) LEFT JOIN n USING (rec_id, patch)""",
    "v_raster",
)
def _(spark, d):
    p = views.raster(spark, d).filter("label > 0").withColumnRenamed("label", "patch")
    s, _ = refine.coverage(p, "azi", "alt", "v", 2.0)
    return s.select("rec_id", "patch", r6("jac_coverage").alias("jac_coverage"), "actual_coverage", "n_outside")


@query(
    "greedy_pairs",
    """WITH RECURSIVE e AS (SELECT l_linenumber AS rec_id, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, min(row(l_extendedprice, -l_quantity)) AS m
         FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL),
       t(rec_id, a, b, n, won) AS (SELECT rec_id, a, b, row_number() OVER (PARTITION BY rec_id ORDER BY m, a, b), false FROM e
         UNION ALL
         (WITH p AS (SELECT rec_id, n, unnest([a, b]) AS p FROM t WHERE NOT won),
            low AS (SELECT rec_id, p, min(n) AS n FROM p GROUP BY ALL),
            f AS (SELECT rec_id, n FROM low GROUP BY rec_id, n HAVING count(*) = 2),
            used AS (SELECT p.rec_id, p.p FROM p JOIN f USING (rec_id, n))
          SELECT t.rec_id, a, b, t.n, f.n IS NOT NULL FROM t LEFT JOIN f ON f.rec_id = t.rec_id AND f.n = t.n
            LEFT JOIN used ua ON ua.rec_id = t.rec_id AND ua.p = a LEFT JOIN used ub ON ub.rec_id = t.rec_id AND ub.p = b
          WHERE NOT won AND (f.n IS NOT NULL OR (ua.p IS NULL AND ub.p IS NULL))))
       SELECT rec_id, a, b FROM t WHERE won""",
)
def _(spark, d):
    li = views.table(spark, d, "lineitem").filter("l_partkey <> l_suppkey")
    c = li.select(
        F.col("l_linenumber").alias("rec_id"), F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"),
        F.col("l_extendedprice").alias("ratio"), (-F.col("l_quantity")).alias("neg_area"),
    )
    return refine.greedy_pairs(c)  # a pair that is there more than once counts where it comes first


@query("split_merge")
def _(spark, d):
    s = smooth(spark, d)
    frame = views.raster(spark, d).join(s.select(*PX, "vfs_smooth"), PX)
    mask = s.filter("abs(vfs_smooth) > 0.02").select("rec_id", "height", "width", "y", "x")
    p = areas.extract_patches(mask, s, open_n=0, close_n=1, dilation=1, min_px=4)
    out = refine.split_merge(
        p, frame, azi="azi", alt="alt", det="det", split_overlap=0.05, cut_step=2.0, merge_overlap=0.2, size=2.0,
        close_n=1, box=3, min_px=4,
    )
    return out.select(*PX, "patch", "sign")


@query("split_fuse")
def _(spark, d):
    s = stencil.gaussian_smooth(views.raster(spark, d), ["v"], 4.0).withColumnRenamed("v", "vfs_smooth")
    # positions that vary smoothly over the frame, jittered by the data
    frame = views.raster(spark, d).withColumns(
        {"azi": F.col("x") + F.col("azi") * 0.005, "alt": F.col("y") + F.col("alt") * 0.005}
    )
    mask = s.filter("abs(vfs_smooth) > 0.005").select("rec_id", "height", "width", "y", "x")
    p = areas.sign_patches(mask, s, "vfs_smooth")
    return refine.split_fuse(p, frame, azi="azi", alt="alt", um_per_pixel=500.0, opening_radius=1, smooth_sigma=1.0).select(*PX, "patch", "sign")
