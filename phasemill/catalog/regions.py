"""Queries over cortex masks, patches and area maps."""

from pyspark.sql import functions as F

from phasemill.catalog import sqlmask as sm
from phasemill.catalog.registry import query
from phasemill.catalog.sqlviews import gaussian_sql
from phasemill.functions.columns import r6
from phasemill.operators import areas, stencil
from phasemill.operators.stencil import cross, disk
from phasemill.sources import views

PX = ["rec_id", "y", "x"]
_REL = "least(q, 1 - abs(v), 1 - abs(w), 1 - det)"


def _rel(spark, d):
    r = views.raster(spark, d)
    return r.withColumns(
        {
            "rel_azi_fwd": F.col("q"), "rel_azi_rev": F.lit(1.0) - F.abs("v"),
            "rel_alt_fwd": F.lit(1.0) - F.abs("w"), "rel_alt_rev": F.lit(1.0) - F.col("det"),
        }
    )


_RM = f"(SELECT rec_id, height, width, y, x FROM v_raster WHERE {_REL} >= 0.8)"
CORTEX = sm.fill("lc")


@query("cortex_reliability", f"WITH lc AS MATERIALIZED (SELECT rec_id, height, width, y, x FROM {sm.largest(_RM)}) SELECT rec_id, y, x FROM {CORTEX}", "v_raster")
def _(spark, d):
    return areas.cortex_mask(_rel(spark, d), "reliability", threshold=0.8).select(*PX)


SMOOTH = f"SELECT rec_id, height, width, y, x, v FROM ({gaussian_sql('v_raster', ['v'], 1.5)})"


def smooth(spark, d):
    return stencil.gaussian_smooth(views.raster(spark, d), ["v"], 1.5).withColumnRenamed("v", "vfs_smooth")


@query(
    "cortex_sigma_bound",
    f"""WITH s AS MATERIALIZED ({SMOOTH}), g AS MATERIALIZED (SELECT s.rec_id, height, width, y, x FROM s JOIN (SELECT rec_id, stddev_samp(v) AS sd FROM s GROUP BY rec_id) USING (rec_id) WHERE abs(v) > 0.5 * sd * 0.5),
        o AS MATERIALIZED (SELECT * FROM {sm.dilate(sm.erode("g", disk(2), True), disk(2))}),
        c AS MATERIALIZED (SELECT * FROM {sm.cropped(sm.erode(sm.dilate(sm.grown("o", 2), disk(2)), disk(2), True), 2)}),
        f AS MATERIALIZED (SELECT * FROM {sm.fill("c")}), dl AS MATERIALIZED (SELECT * FROM {sm.dilate("f", disk(1))}),
        f2 AS MATERIALIZED (SELECT * FROM {sm.fill("dl")})
        SELECT rec_id, y, x FROM {sm.largest("f2")}""",
    "v_raster",
)
def _(spark, d):
    return areas.cortex_mask(smooth(spark, d), "sigma_bound", k=0.5, close=2, dilate=1).select(*PX)


@query(
    "cortex_magnitude",
    """SELECT rec_id, y, x FROM v_raster JOIN (SELECT rec_id, min(power(det, 0.7)) AS lo, max(power(det, 0.7)) AS hi FROM v_raster GROUP BY rec_id) USING (rec_id)
       WHERE (power(det, 0.7) - lo) / (hi - lo) >= 0.45""",
    "v_raster",
)
def _(spark, d):
    return areas.cortex_mask(views.raster(spark, d), "magnitude", exponent=0.7, threshold=0.45, magnitude="det").select(*PX)


@query("cortex_none", "SELECT rec_id, y, x FROM v_raster", "v_raster")
def _(spark, d):
    return areas.cortex_mask(views.raster(spark, d), "none").select(*PX)


@query(
    "patch_threshold",
    """WITH i AS (SELECT * FROM v_raster WHERE det > 0.03), t AS (SELECT rec_id, stddev_samp(v) * 1.5 * 0.5 AS thr FROM i GROUP BY rec_id)
       SELECT 'sigma' AS method, rec_id, y, x, round(thr, 6) + 0.0 AS threshold FROM i JOIN t USING (rec_id) WHERE abs(v) > thr
       UNION ALL SELECT 'fixed', rec_id, y, x, 0.1 FROM i WHERE abs(v) >= 0.1""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d).withColumnRenamed("v", "vfs_smooth")
    cortex = r.filter("det > 0.03")
    out = None
    for m in ("sigma", "fixed"):
        mask, thr = areas.patch_threshold(r, cortex, m, value=0.1)
        one = mask.join(thr, "rec_id").select(F.lit(m).alias("method"), *PX, r6("threshold").alias("threshold"))
        out = one if out is None else out.union(one)
    return out


def _patches(spark, d):
    return views.raster(spark, d).filter("label > 0").withColumnRenamed("label", "patch").withColumn("sign", F.when(F.col("v") >= 0, 1).otherwise(-1))


@query(
    "adjacent_patches",
    f"""WITH d AS (SELECT * FROM {sm.dilate("(SELECT rec_id, label, height, width, y, x FROM v_raster WHERE label > 0)", cross(1), "rec_id, label")})
        SELECT DISTINCT a.rec_id, a.label AS a, b.label AS b FROM d a JOIN d b ON a.rec_id = b.rec_id AND a.y = b.y AND a.x = b.x AND a.label < b.label""",
    "v_raster",
)
def _(spark, d):
    return areas.adjacent_patches(_patches(spark, d), 2)


_GRID = """(SELECT rec_id, min(alt) - 2.0 AS a0, min(azi) - 2.0 AS z0, CAST(ceil((max(alt) + 2.0 - (min(alt) - 2.0)) / 2.0) AS INTEGER) AS height,
    CAST(ceil((max(azi) + 2.0 - (min(azi) - 2.0)) / 2.0) AS INTEGER) AS width FROM v_raster GROUP BY rec_id)"""
_CELLS = f"""(SELECT DISTINCT r.rec_id, label, g.height, g.width, CAST(floor((alt - a0) / 2.0) AS INTEGER) AS y, CAST(floor((azi - z0) / 2.0) AS INTEGER) AS x
    FROM v_raster r JOIN {_GRID} g USING (rec_id) WHERE label > 0)"""
_VS = f"vs AS MATERIALIZED (SELECT * FROM {sm.erode(sm.dilate(_CELLS, cross(1), 'rec_id, label'), cross(1), False, 'rec_id, label')})"


def _projected(spark, d):
    r = views.raster(spark, d)
    return areas.project_visual(_patches(spark, d), areas.visual_grid(r, "alt", "azi", 2.0), "alt", "azi", 2.0, 1)


@query("project_visual", f"WITH {_VS} SELECT rec_id, label AS patch, y, x FROM vs", "v_raster")
def _(spark, d):
    return _projected(spark, d).select("rec_id", "patch", "y", "x")


@query(
    "patch_overlap",
    f"""WITH {_VS} SELECT p.rec_id, p.label AS a, q.label AS b, count(*) AS n_shared, any_value(u.n) * 4.0 AS area_a FROM vs p JOIN vs q ON p.rec_id = q.rec_id AND p.y = q.y AND p.x = q.x AND p.label < q.label
        JOIN (SELECT rec_id, label, count(*) AS n FROM vs GROUP BY ALL) u ON u.rec_id = p.rec_id AND u.label = p.label GROUP BY ALL""",
    "v_raster",
)
def _(spark, d):
    vs = _projected(spark, d)
    area = areas.visual_area(vs, 2.0).select("rec_id", F.col("patch").alias("a"), F.col("visual_area").alias("area_a"))
    return areas.patch_overlap(vs).join(area, ["rec_id", "a"])


_LBA = "SELECT rec_id, label AS patch, count(*) AS area_px, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY count(*) DESC, label) AS INTEGER) AS label FROM v_raster WHERE label > 0 GROUP BY rec_id, v_raster.label"


@query("label_by_area", f"SELECT rec_id, patch, area_px, label FROM ({_LBA})", "v_raster")
def _(spark, d):
    return areas.label_by_area(_patches(spark, d)).select("rec_id", "patch", "area_px", "label")


@query(
    "assemble_labels",
    f"""WITH o AS (SELECT rec_id, y, x, label AS patch FROM v_raster WHERE label > 0 UNION ALL SELECT rec_id, y, x + 1, label FROM v_raster WHERE label > 0 AND x < width - 1),
        n AS (SELECT rec_id, patch, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY count(*) DESC, patch) AS INTEGER) AS label FROM o GROUP BY rec_id, patch),
        t AS (SELECT r.rec_id, r.y, r.x, coalesce(max(n.label), 0) AS label FROM v_raster r LEFT JOIN o ON o.rec_id = r.rec_id AND o.y = r.y AND o.x = r.x
              LEFT JOIN n ON n.rec_id = o.rec_id AND n.patch = o.patch GROUP BY r.rec_id, r.y, r.x)
        SELECT rec_id, y, x, label, label > 0 AND (coalesce(lag(label) OVER wx <> label, true) OR coalesce(lead(label) OVER wx <> label, true)
          OR coalesce(lag(label) OVER wy <> label, true) OR coalesce(lead(label) OVER wy <> label, true)) AS border FROM t
        WINDOW wx AS (PARTITION BY rec_id, y ORDER BY x), wy AS (PARTITION BY rec_id, x ORDER BY y)""",
    "v_raster",
)
def _(spark, d):
    p = _patches(spark, d).select("rec_id", "patch", "sign", "height", "width", "y", "x")
    both = p.unionByName(p.withColumn("x", F.col("x") + 1).filter("x < width"))  # overlapping patches
    return areas.assemble_labels(views.raster(spark, d), both).select(*PX, "label", "border")


_V1 = """(SELECT rec_id, avg(alt) AS ac, avg(azi) AS zc FROM v_raster JOIN (SELECT rec_id, label FROM (SELECT rec_id, label, count(*) AS n FROM v_raster WHERE label > 0 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, label DESC) = 1) USING (rec_id, label) GROUP BY rec_id)"""


@query(
    "eccentricity",
    f"""SELECT rec_id, y, x, round(CASE WHEN label > 0 THEN degrees(atan(sqrt(power(tan(da), 2) + power(tan(dz), 2) / greatest(power(cos(da), 2), 1e-12)))) ELSE 0 END, 6) + 0.0 AS eccentricity,
          round(CASE WHEN label > 0 THEN degrees(atan2(alt - ac, azi - zc)) ELSE 0 END, 6) + 0.0 AS polar
        FROM (SELECT *, radians(alt - ac) AS da, radians(azi - zc) AS dz FROM v_raster JOIN {_V1} USING (rec_id))""",
    "v_raster",
)
def _(spark, d):
    e = areas.eccentricity(views.raster(spark, d), "alt", "azi")
    return e.select(*PX, r6("eccentricity").alias("eccentricity"), r6("polar").alias("polar"))


@query(
    "eccentricity_sampled",
    f"""WITH m AS (SELECT rec_id, height, width, y, x FROM v_raster WHERE label > 0 AND label <> 3), o AS MATERIALIZED (SELECT * FROM {sm.dilate(sm.erode("m", disk(1), True), disk(1))}),
        l AS MATERIALIZED (SELECT *, avg(y) OVER (PARTITION BY rec_id) AS cy, avg(x) OVER (PARTITION BY rec_id) AS cx FROM {sm.largest("o")}),
        s AS (SELECT rec_id, y, x FROM l QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY CASE WHEN y = floor(cy + 0.5) AND x = floor(cx + 0.5) THEN 0 ELSE 1 END, (y-cy)*(y-cy) + (x-cx)*(x-cx), y, x) = 1),
        c AS (SELECT r.rec_id, alt AS ac, azi AS zc FROM v_raster r JOIN s USING (rec_id, y, x))
        SELECT rec_id, y, x, round(CASE WHEN label > 0 AND label <> 3 AND ac IS NOT NULL THEN degrees(atan(sqrt(power(tan(dz), 2) + power(tan(da), 2) / power(cos(dz), 2)))) ELSE 0 END, 6) + 0.0 AS eccentricity
        FROM (SELECT *, radians(alt - ac) AS da, radians(azi - zc) AS dz FROM v_raster LEFT JOIN c USING (rec_id))""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d).withColumn("label", F.when(F.col("label") == 3, 0).otherwise(F.col("label")))
    return areas.eccentricity(r, "alt", "azi", "pixel_sample", radius=1).select(*PX, r6("eccentricity").alias("eccentricity"))


@query(
    "derived_maps",
    """SELECT rec_id, y, x, round(CASE WHEN label > 0 THEN 1 / greatest(det, 1e-12) ELSE 0 END, 6) + 0.0 AS magnification, NOT (det > 0.03) AS off_cortex,
         round(CASE WHEN det > 0.03 THEN CASE WHEN abs(v) >= 0.1 THEN v ELSE 0 END END, 6) + 0.0 AS vfs_thresholded,
         coalesce(label > 0 AND lead(label) OVER wx > 0 AND floor(azi / 4) <> floor(lead(azi) OVER wx / 4), false)
         OR coalesce(label > 0 AND lead(label) OVER wy > 0 AND floor(azi / 4) <> floor(lead(azi) OVER wy / 4), false) AS contours_azi
       FROM v_raster WINDOW wx AS (PARTITION BY rec_id, y ORDER BY x), wy AS (PARTITION BY rec_id, x ORDER BY y)""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d)
    thr = r.select("rec_id").distinct().withColumn("threshold", F.lit(0.1))
    m = areas.derived_maps(r, r.filter("det > 0.03"), thr, azi="azi", alt="alt", det="det", sign="v")
    t = F.col("vfs_thresholded")
    return m.select(
        *PX, r6("magnification").alias("magnification"), F.isnan(t).alias("off_cortex"),
        r6(F.when(~F.isnan(t), t)).alias("vfs_thresholded"), "contours_azi",
    )


def _sweep_sql():
    cells = []
    for fam, unit, ps in (
        ("fixed", "1", areas.SWEEP_FIXED), ("global_sigma", "g", areas.SWEEP_SIGMA), ("cortex_sigma", "c", areas.SWEEP_SIGMA)
    ):
        cells += [f"SELECT rec_id, '{fam}' AS family, CAST({p} AS DOUBLE) AS parameter, {unit} * CAST({p} AS DOUBLE) AS threshold FROM sd" for p in ps]
    k = "rec_id, family, parameter"
    return f"""WITH sd AS (SELECT rec_id, stddev_pop(v) AS g, stddev_pop(v) FILTER (WHERE det > 0.02) AS c FROM v_raster GROUP BY rec_id), pl AS MATERIALIZED ({' UNION ALL '.join(cells)}),
      h AS MATERIALIZED (SELECT {k}, height, width, y, x FROM v_raster JOIN pl USING (rec_id) WHERE det > 0.02 AND abs(v) >= threshold),
      o AS MATERIALIZED (SELECT * FROM {sm.dilate(sm.erode("h", cross(1), False, k), cross(1), k)}),
      z AS (SELECT {k}, root FROM {sm.roots("o", 4, k)} GROUP BY ALL HAVING count(*) >= 8)
      SELECT pl.rec_id, pl.family, pl.parameter, count(z.root) AS n_patches FROM pl LEFT JOIN z USING ({k}) GROUP BY ALL"""


@query("threshold_sweep", _sweep_sql(), "v_raster")
def _(spark, d):
    r = views.raster(spark, d)
    return areas.threshold_sweep(r, r.filter("det > 0.02"), "v", 8, 1).drop("threshold")


def patches_sql(least: int, dilation: int) -> str:
    """CTEs `s` (smoothed surface) and `patch` (rec_id, height, width, y, x, patch, sign) of `extract_patches`."""
    c = cross(1)
    kept = f"SELECT l.* FROM {sm.labels('split')} l SEMI JOIN (SELECT DISTINCT m.rec_id, m.label FROM {sm.labels('split')} m SEMI JOIN raw USING (rec_id, y, x)) USING (rec_id, label)"
    return f"""s AS MATERIALIZED ({SMOOTH}), g AS MATERIALIZED (SELECT rec_id, height, width, y, x FROM s WHERE abs(v) > 0.02),
        one AS MATERIALIZED (SELECT * FROM {sm.roots("g")}),
        raw AS MATERIALIZED (SELECT DISTINCT rec_id, height, width, y, x FROM {sm.erode(sm.dilate("one", c, "rec_id, root"), c, False, "rec_id, root")}),
        total AS MATERIALIZED (SELECT * FROM {sm.dilate("raw", cross(dilation))}),
        halo AS MATERIALIZED (SELECT * FROM total ANTI JOIN raw USING (rec_id, y, x)), line AS MATERIALIZED (SELECT * FROM {sm.thin("halo")}),
        split AS MATERIALIZED (SELECT * FROM total ANTI JOIN line USING (rec_id, y, x)),
        kept AS MATERIALIZED (SELECT rec_id, height, width, y, x FROM ({kept})),
        area AS MATERIALIZED (SELECT * FROM (SELECT l.rec_id, l.height, l.width, l.y, l.x, label AS patch, count(*) OVER w AS n,
          CASE WHEN sum(v) OVER w >= 0 THEN 1 ELSE -1 END AS sign FROM {sm.labels('kept')} l JOIN s USING (rec_id, y, x) WINDOW w AS (PARTITION BY rec_id, label)) WHERE n >= {least}),
        wide AS MATERIALIZED (SELECT * FROM {sm.dilate("(SELECT rec_id, patch, height, width, y, x FROM area)", c, "rec_id, patch")}),
        patch AS MATERIALIZED (SELECT rec_id, height, width, y, x, patch, sign FROM area SEMI JOIN
          (SELECT a.rec_id, a.patch FROM wide a JOIN wide b ON a.rec_id = b.rec_id AND a.y = b.y AND a.x = b.x AND a.patch <> b.patch) USING (rec_id, patch))"""


@query("extract_patches", f"WITH {patches_sql(4, 2)} SELECT rec_id, y, x, patch, sign FROM patch", "v_raster")
def _(spark, d):
    s = smooth(spark, d)
    mask = s.filter("abs(vfs_smooth) > 0.02").select("rec_id", "height", "width", "y", "x")
    return areas.extract_patches(mask, s, open_n=0, close_n=1, dilation=2, min_px=4).select(*PX, "patch", "sign")


@query(
    "compare_variants",
    f"""WITH s AS ({SMOOTH}), v AS (SELECT rec_id, 'raw' AS variant, v FROM v_raster UNION ALL SELECT rec_id, 'smooth', v FROM s)
        SELECT rec_id, variant, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(median(v), 6) + 0.0 AS median, round(max(v), 6) + 0.0 AS max FROM v GROUP BY GROUPING SETS ((rec_id, variant), (variant))""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d)
    c = areas.compare_variants(lambda sigma: stencil.gaussian_smooth(r, ["v"], sigma), {"raw": {"sigma": 0.0}, "smooth": {"sigma": 1.5}}, "v")
    return c.select("rec_id", "variant", "n", r6("mean").alias("mean"), r6("median").alias("median"), r6("max").alias("max"))
