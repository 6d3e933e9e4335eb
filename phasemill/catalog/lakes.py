"""Queries over the lake: readers, checks, migration, manifests, agreement."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.catalog.registry import query
from phasemill.functions.columns import r6
from phasemill.operators import agree, manifest, stats
from phasemill.session import ensure_checkpoint_dir
from phasemill.sources import lake, views


def _recordings(spark, d):
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("rec_id"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")


@query("library_recent", "SELECT o_orderkey AS rec_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def _(spark, d):
    return lake.library_recent(_recordings(spark, d), 50).select("rec_id", "created_at")


@query("load_frames", "SELECT rec_id, frame_idx, y, count(*) AS n_px, sum(p)::BIGINT AS total FROM v_movie GROUP BY ALL", "v_movie")
def _(spark, d):
    path = f"{ensure_checkpoint_dir(spark)}/movie-{uuid.uuid4().hex}"
    lake.write_frames(views.movie_rows(spark, d), path)
    f = lake.load_frames(spark, path)
    there = F.array_compact("pixels")  # a null is a pixel that the frame does not have
    total = F.aggregate(there, F.lit(0).cast("bigint"), lambda a, p: a + p)
    return f.select(F.col("rec_id").cast("bigint").alias("rec_id"), "frame_idx", "y", F.size(there).cast("bigint").alias("n_px"), total.alias("total"))


@query("write_read_map", "SELECT rec_id, y, x, round(alt, 6) + 0.0 AS alt FROM v_raster", "v_raster")
def _(spark, d):
    path = f"{ensure_checkpoint_dir(spark)}/maps-{uuid.uuid4().hex}"
    lake.write_maps(views.raster(spark, d), path)
    return lake.read_map(spark, path, "alt").select(F.col("rec_id").cast("bigint").alias("rec_id"), "y", "x", r6("alt").alias("alt"))


@query(
    "parse_schedule",
    """SELECT vec_id AS rec_id, CAST(i AS INTEGER) AS sweep_idx, list_extract(['LR','RL','TB','BT'], CAST((vec_id + i) % 4 + 1 AS INTEGER)) AS label,
         round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS start_sec, round(CAST(embedding[i + 11] AS DOUBLE), 6) + 0.0 AS end_sec
       FROM embeddings, range(10) t(i) WHERE i < least(vec_id % 5 + 3, vec_id % 7 + 2, 6)""",
)
def _(spark, d):
    four = F.array(*[F.lit(s) for s in ("LR", "RL", "TB", "BT")])
    names = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("vec_id") % 5 + 2),
        lambda i: F.element_at(four, ((F.col("vec_id") + i) % 4 + 1).cast("int")),
    )
    v = F.transform("embedding", lambda e: e.cast("double"))
    e = views.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("rec_id"), F.to_json(names).alias("sweep_sequence"),
        F.slice(v, F.lit(1), (F.col("vec_id") % 7 + 2).cast("int")).alias("sweep_start_sec"),
        F.slice(v, 11, 6).alias("sweep_end_sec"),
    )
    s = lake.parse_schedule(e)
    return s.select("rec_id", "sweep_idx", "label", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"))


@query(
    "parse_acquisition",
    """SELECT event_id, CASE WHEN m = 0 OR m = 1 THEN 100 ELSE value END AS azi_angular_range, CASE WHEN m = 0 OR m = 1 THEN 0 ELSE event_id % 4 END AS rotation_k,
         CASE WHEN m = 0 OR m = 2 THEN CAST(20 AS DOUBLE) ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS um_per_pixel, CAST(100 AS DOUBLE) AS alt_angular_range,
         CASE m WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 3 END AS n_missing, CASE m WHEN 0 THEN 'defaulted' ELSE 'partial' END AS provenance
       FROM (SELECT *, event_id % 4 AS m FROM events)""",
)
def _(spark, d):
    m = F.col("event_id") % 4
    e = views.table(spark, d, "events")
    # 0: no attributes, 1: rig only, 2: geometry only, 3: both
    geo = F.to_json(F.struct(F.struct(F.col("value").alias("azi_angular_range"), (F.col("event_id") % 4).alias("rotation_k")).alias("stimulus_geometry")))
    k = F.get_json_object("props", "$.k")
    rig = F.concat(F.lit('{"camera": {"um_per_pixel": '), k, F.lit("}}"))
    e = e.select("event_id", F.when(m % 2 == 1, rig).alias("rig_json"), F.when(m >= 2, geo).alias("exp_json"))
    a = lake.parse_acquisition(e)
    return a.select(
        "event_id", "azi_angular_range", "rotation_k", "um_per_pixel", "alt_angular_range", F.size("missing").alias("n_missing"), "provenance"
    )


@query(
    "inspect",
    """WITH s AS (SELECT rec_id, sum(n)::BIGINT AS n_sweeps, count(*) AS n_directions, min(n) AS cycles FROM (SELECT rec_id, label, count(*) AS n FROM v_sweeps GROUP BY ALL) GROUP BY rec_id),
       m AS (SELECT DISTINCT user_id AS rec_id FROM events WHERE event_type = 'signup' AND event_id % 2 = 0),
       r AS (SELECT user_id AS rec_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS leaves FROM events WHERE value > 150 GROUP BY user_id)
       SELECT c.rec_id, s.rec_id IS NOT NULL AS has_schedule, m.rec_id IS NOT NULL AS has_maps, r.rec_id IS NOT NULL AS has_results, n_sweeps, n_directions, cycles, leaves
       FROM (SELECT c_custkey AS rec_id FROM customer) c LEFT JOIN s USING (rec_id) LEFT JOIN m USING (rec_id) LEFT JOIN r USING (rec_id)""",
    "v_sweeps",
)
def _(spark, d):
    cat = views.table(spark, d, "customer").select(F.col("c_custkey").alias("rec_id"))
    e = views.table(spark, d, "events").withColumnRenamed("user_id", "rec_id")
    maps = e.filter("event_type = 'signup' AND event_id % 2 = 0").select("rec_id")
    res = e.filter("value > 150").select("rec_id", F.col("event_type").alias("leaf"))
    out = lake.inspect(cat, views.sweeps(spark, d), maps, res)
    return out.withColumn("leaves", F.array_join("leaves", ","))


@query(
    "polar_import",
    """SELECT rec_id, direction, y, x, round(m * cos(p), 6) + 0.0 AS re, round(m * sin(p), 6) + 0.0 AS im FROM
         (SELECT rec_id, y, x, 'azi_fwd' AS direction, det AS m, alt AS p FROM v_raster UNION ALL SELECT rec_id, y, x, 'alt_rev', det, azi FROM v_raster)""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d)
    rows = None
    for name, ph in (("azi_fwd", "alt"), ("alt_rev", "azi"), ("blank", "alt")):  # the last is not a direction
        one = r.select("rec_id", "y", "x", F.lit(name).alias("direction"), F.col("det").alias("mag"), F.col(ph).alias("phase"))
        rows = one if rows is None else rows.unionByName(one)
    p = lake.polar_import(rows)
    return p.select("rec_id", "direction", "y", "x", r6("re").alias("re"), r6("im").alias("im"))


@query(
    "roi_rows",
    """WITH a AS (SELECT rec_id, label, y, x, x - row_number() OVER (PARTITION BY rec_id, y, label ORDER BY x) AS g FROM v_raster WHERE label > 0)
       SELECT rec_id, label, y, min(x) AS x_first, max(x) AS x_last, sign FROM a JOIN
         (SELECT rec_id, label, CASE WHEN sum(v) >= 0 THEN 1 ELSE -1 END AS sign FROM v_raster WHERE label > 0 GROUP BY ALL) USING (rec_id, label) GROUP BY rec_id, label, y, g, sign""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d)
    return lake.roi_rows(r, stats.area_stats(r, "v").select("rec_id", "label", "sign"))


@query(
    "export_sweeps",
    "SELECT rec_id, sweep_idx, label, CASE label WHEN 'LR' THEN 'azi_fwd' WHEN 'RL' THEN 'azi_rev' WHEN 'TB' THEN 'alt_fwd' ELSE 'alt_rev' END AS direction, round(start_sec, 6) AS start_time, round(end_sec, 6) AS stop_time FROM v_sweeps",
    "v_sweeps",
)
def _(spark, d):
    s = lake.sweep_rows(views.sweeps(spark, d))
    return s.withColumn("start_time", r6("start_time")).withColumn("stop_time", r6("stop_time"))


@query(
    "timing_forensics",
    """SELECT rec_id, frame_idx, hw_us - lag(hw_us) OVER w AS hw_delta, sys_us - lag(sys_us) OVER w AS sys_delta, seq - lag(seq) OVER w AS seq_step
       FROM v_stamps WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx)""",
    "v_stamps",
)
def _(spark, d):
    return lake.forensics_rows(views.stamps(spark, d))


_STAGES = {
    "smoothing": ("gaussian", {"gaussian": {"sigma_um": 60.0}}),
    "cortex": ("sigma_bound", {"sigma_bound": {"k": 1.5, "dilate": 3.0}, "reliability": {"threshold": 0.5}}),
    "average": ("simple", {}),
}


@query(
    "migrate_params",
    """SELECT event_id AS rec_id, s.stage, CASE s.stage WHEN 'smoothing' THEN 'gaussian' WHEN 'cortex' THEN CASE WHEN m = 0 THEN 'reliability' WHEN m = 1 THEN 'unrestricted' ELSE 'sigma_bound' END ELSE 'simple' END AS method,
         CASE s.stage WHEN 'smoothing' THEN CASE WHEN m = 3 THEN 'sigma_um=' || k || '.0' ELSE 'sigma_um=60.0' END WHEN 'cortex' THEN
           CASE m WHEN 0 THEN 'threshold=' || k || '.0' WHEN 1 THEN '' WHEN 2 THEN 'dilate=3.0,k=' || k || '.0' ELSE 'dilate=3.0,k=1.5' END ELSE '' END AS tunables,
         CASE WHEN event_id % 10 = 0 THEN 'mystery' ELSE '' END AS unknown
       FROM (SELECT event_id, event_id % 4 AS m, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), (VALUES ('smoothing'), ('cortex'), ('average')) s(stage)""",
)
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    m = F.col("event_id") % 4
    body = (
        F.when(m == 0, F.concat(F.lit('"cortex": {"method": "reliability", "threshold": '), k, F.lit("}")))
        .when(m == 1, F.lit('"cortex": {"method": "full_frame"}, "rotation": 2'))
        .when(m == 2, F.concat(F.lit('"cortex": {"method": "sigma_bound", "k": '), k, F.lit("}")))
        .otherwise(F.concat(F.lit('"smoothing": {"method": "gaussian", "gaussian": {"sigma_um": '), k, F.lit("}}")))
    )
    extra = F.when(F.col("event_id") % 10 == 0, F.lit(', "mystery": 1')).otherwise(F.lit(""))
    p = F.concat(F.lit("{"), body, extra, F.lit("}"))
    e = views.table(spark, d, "events").select(F.col("event_id").alias("rec_id"), p.alias("params"))
    out = lake.migrate_params(e, "params", _STAGES, ["rotation"], {"cortex": {"full_frame": "unrestricted"}})
    pairs = F.transform(F.array_sort(F.map_entries("tunables")), lambda t: F.concat_ws("=", t["key"], t["value"].cast("string")))
    return out.select("rec_id", "stage", "method", F.array_join(pairs, ",").alias("tunables"), F.array_join("unknown", ",").alias("unknown"))


@query(
    "schema_check",
    """WITH o AS (SELECT c_custkey AS rec_id, unnest(CASE c_custkey % 3 WHEN 0 THEN ['frames', 'sweeps'] WHEN 1 THEN ['frames', 'notes', 'maps'] ELSE ['sweeps', 'maps'] END) AS entity, c_custkey % 5 AS t FROM customer)
       SELECT rec_id, 'frames' AS entity, 'missing' AS violation FROM o GROUP BY rec_id HAVING NOT bool_or(entity = 'frames')
       UNION ALL SELECT rec_id, 'sweeps', 'missing' FROM o GROUP BY rec_id HAVING NOT bool_or(entity = 'sweeps')
       UNION ALL SELECT rec_id, entity, 'undeclared' FROM o WHERE entity = 'notes'
       UNION ALL SELECT rec_id, entity, 'dtype' FROM o WHERE entity = 'frames' AND t = 0""",
)
def _(spark, d):
    m = F.col("c_custkey") % 3

    def arr(*names):
        return F.array(*[F.lit(n) for n in names])

    ents = F.when(m == 0, arr("frames", "sweeps")).when(m == 1, arr("frames", "notes", "maps")).otherwise(arr("sweeps", "maps"))
    o = views.table(spark, d, "customer").select(F.col("c_custkey").alias("rec_id"), F.explode(ents).alias("entity"))
    wrong = (F.col("entity") == "frames") & (F.col("rec_id") % 5 == 0)
    o = o.withColumn("dtype", F.when(wrong, "float").otherwise("int"))
    c = spark.createDataFrame(
        [("frames", "int", True), ("sweeps", "int", True), ("maps", "int", False)], "entity string, dtype string, required boolean"
    )
    return lake.schema_check(o, c)


# ---- manifest --------------------------------------------------------------------------------------------


def _params(spark, d, edited=False):
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("rec_id"), "o_orderstatus", "o_orderpriority")
    out = o
    for p in manifest.PARAMETERS:
        out = out.withColumn(p, F.concat(F.lit(f"{p}:"), "o_orderstatus", "o_orderpriority"))
    if edited:  # every seventh recording was stored under another cortex setting, every eleventh smoothing
        out = out.withColumn("cortex_source", F.when(F.col("rec_id") % 7 == 0, "old").otherwise(F.col("cortex_source")))
        out = out.withColumn("rectification", F.when(F.col("rec_id") % 11 == 0, "old").otherwise(F.col("rectification")))
    return out.drop("o_orderstatus", "o_orderpriority")


def _fp_sql():
    cols = "rec_id, s"
    inner = "(SELECT o_orderkey AS rec_id, o_orderstatus || o_orderpriority AS s FROM orders)"
    for stage, (reads, deps) in manifest.STAGES.items():
        parts = [f"'{manifest.VERSION}'", f"'{stage}'"] + [f"'{p}={p}:' || s" for p in reads] + [f"fp_{x}" for x in deps]
        inner = f"(SELECT *, sha256(concat_ws('|', {', '.join(parts)})) AS fp_{stage} FROM {inner})"
        cols += f", fp_{stage}"
    return " UNION ALL ".join(f"SELECT rec_id, '{s}' AS stage, fp_{s} AS fp FROM k" for s in manifest.STAGES), inner


_union, _inner = _fp_sql()


@query("stage_fingerprints", f"WITH k AS MATERIALIZED {_inner} {_union}")
def _(spark, d):
    return manifest.stage_fingerprints(_params(spark, d))


_TAIL = ["cortex_source", "patch_threshold", "patch_extraction", "patch_refinement", "labels", "eccentricity", "derived_maps"]


@query(
    "stale_stages",
    f"""SELECT o_orderkey AS rec_id, stage, o_orderkey % 11 = 0 AND stage <> 'baseline' OR o_orderkey % 11 = 0 AND stage = 'baseline'
          OR o_orderkey % 7 = 0 AND stage IN ({', '.join(f"'{s}'" for s in _TAIL)})
          OR o_orderkey % 13 = 0 AND stage IN ('labels', 'patch_refinement', 'patch_extraction') AS runs
        FROM orders, (VALUES {', '.join(f"('{s}')" for s in manifest.STAGES)}) t(stage)""",
)
def _(spark, d):
    new = manifest.stage_fingerprints(_params(spark, d))
    old = manifest.stage_fingerprints(_params(spark, d, edited=True))
    have = new.filter("NOT (rec_id % 13 = 0 AND stage = 'labels')").select("rec_id", "stage")
    return manifest.stale_stages(new, old, have)


_AGAIN = "CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END"
_AGAIN_TAIL = "CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 THEN 2 ELSE 1 END"


def _restored_sql():
    inner = f"(SELECT o_orderkey AS rec_id, {_AGAIN} AS g, {_AGAIN_TAIL} AS t FROM orders)"
    for stage, (_, deps) in list(manifest.STAGES.items())[1:]:
        terms = [f"v_{x}" for x in deps if x != "baseline"] + ["t" if stage in _TAIL else "g"]
        inner = f"(SELECT *, {' + '.join(terms)} AS v_{stage} FROM {inner})"
    kept = [st for st in manifest.STAGES if st != "baseline" and st not in manifest.NOT_STORED]
    rows = [f"SELECT rec_id, '{st}' AS stage, {'t' if st in _TAIL else 'g'} AS made_in, v_{st} AS v FROM k" for st in kept]
    return f"WITH k AS MATERIALIZED {inner} " + " UNION ALL ".join(rows)


@query("restored_results", _restored_sql())
def _(spark, d):
    """Two runs into a store, the second with edited parameters: each result says which run made it, and sums what it read."""
    def stages(run):
        def stage(name, deps):
            def fn(of):
                out, total = of.recs, F.lit(run)
                for dep in deps:
                    out = out.join(of(dep, dep).select("rec_id", F.col("v").alias(f"_{dep}")), "rec_id")
                    total = total + F.col(f"_{dep}")
                return {name: out.select("rec_id", F.lit(run).alias("made_in"), total.alias("v"))}

            return fn

        return {name: stage(name, [x for x in deps if x != "baseline"]) for name, (_, deps) in manifest.STAGES.items() if name != "baseline"}

    store = manifest.StageStore(spark, f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}")
    for run, edited in ((1, True), (2, False)):
        manifest.restore(store, manifest.stage_keys(_params(spark, d, edited)), stages(run))
    kept = [st for st in manifest.STAGES if st != "baseline" and st not in manifest.NOT_STORED]
    parts = [store.read(st, st).select("rec_id", F.lit(st).alias("stage"), "made_in", "v") for st in kept]
    return reduce(DataFrame.unionByName, parts)


@query(
    "refresh",
    """SELECT n_nationkey AS rec_id, CAST(0 AS INTEGER) AS y, CASE WHEN n_regionkey = 2 THEN 2.0 ELSE 1.0 END AS v FROM nation""",
)
def _(spark, d):
    n = views.table(spark, d, "nation")
    data = n.select(F.col("n_nationkey").alias("rec_id"), F.lit(0).alias("y"), F.lit(1.0).alias("v"))
    runs = n.select(F.col("n_nationkey").alias("rec_id"), F.lit("labels").alias("stage"), (F.col("n_regionkey") == 2).alias("runs"))
    path = f"{ensure_checkpoint_dir(spark)}/refreshed-{uuid.uuid4().hex}"
    manifest.refresh(runs.withColumn("runs", F.lit(True)), data, lambda df: df, path)
    manifest.refresh(runs, data, lambda df: df.withColumn("v", F.lit(2.0)), path)
    return spark.read.parquet(path).select(F.col("rec_id").cast(data.schema["rec_id"].dataType).alias("rec_id"), "y", "v")


# ---- agreement ---------------------------------------------------------------------------------------------


_AGREE_KEYS = ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]


def _pair(spark, d):
    li = views.table(spark, d, "lineitem").select(*_AGREE_KEYS, F.col("l_extendedprice").alias("v"))
    k = F.col("l_orderkey")
    b = li.withColumn(
        "v", F.when(k % 13 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.col("v") * (1 + 1e-9)).otherwise(F.col("v"))
    )
    return li, b


@query(
    "agreement",
    """WITH p AS (SELECT l_returnflag, l_extendedprice AS a, CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN l_extendedprice * (1 + 1e-9) ELSE l_extendedprice END AS b FROM lineitem)
       SELECT l_returnflag, count(*) FILTER (WHERE b IS NOT NULL AND abs(a - b) > greatest(abs(a), abs(b)) * 1e-12) AS n_fail, count(*) FILTER (WHERE b IS NULL) AS n_nan_mismatch, count(b) AS n_finite,
         round(max(abs(a - b)) * 1e3, 6) + 0.0 AS max_abs_milli, count(*) FILTER (WHERE b IS NOT NULL AND a <> b) AS n_exact_fail, false AS vacuous, false AS agrees FROM p GROUP BY l_returnflag""",
)
def _(spark, d):
    a, b = _pair(spark, d)
    keys = _AGREE_KEYS
    tol = agree.Tolerance("linear", rtol=1e-12)
    r = agree.agreement(a, b, keys, "v", tol, ["l_returnflag"])
    ex = agree.agreement(a, b, keys, "v", agree.Tolerance.exact(), ["l_returnflag"]).select("l_returnflag", F.col("n_fail").alias("n_exact_fail"))
    return r.join(ex, "l_returnflag").select(
        "l_returnflag", "n_fail", "n_nan_mismatch", "n_finite", r6(F.col("max_abs") * 1e3).alias("max_abs_milli"), "n_exact_fail", "vacuous", "agrees"
    )


@query(
    "agreement_wrapped",
    """SELECT rec_id, count(*) FILTER (WHERE least(m, 360 - m) > 0.5) AS n_fail, round(max(least(m, 360 - m)), 6) + 0.0 AS max_abs, count(*) AS n_finite FROM
         (SELECT rec_id, ((alt * 9 - (alt * 9 + 359.0 + v * 10)) % 360 + 360) % 360 AS m FROM v_raster) GROUP BY rec_id""",
    "v_raster",
)
def _(spark, d):
    r = views.raster(spark, d)
    a = r.select("rec_id", "y", "x", (F.col("alt") * 9).alias("p"))
    b = r.select("rec_id", "y", "x", (F.col("alt") * 9 + 359.0 + F.col("v") * 10).alias("p"))
    out = agree.agreement(a, b, ["rec_id", "y", "x"], "p", agree.Tolerance("wrap", atol=0.5, period=360.0))
    return out.select("rec_id", "n_fail", r6("max_abs").alias("max_abs"), "n_finite")


@query(
    "recovery_error",
    """SELECT rec_id, count(*) AS n, round(median(abs(alt - azi)), 6) + 0.0 AS median_err, round(max(abs(alt - azi)), 6) + 0.0 AS max_err,
         round(avg(CASE WHEN sign(v) = sign(w) THEN 1 ELSE 0 END), 6) + 0.0 AS sign_accuracy FROM v_raster GROUP BY rec_id""",
    "v_raster",
)
def _(spark, d):
    e = stats.recovery_error(views.raster(spark, d), "alt", "azi", sign=("v", "w"))
    return e.select("rec_id", "n", r6("median_err").alias("median_err"), r6("max_err").alias("max_err"), r6("sign_accuracy").alias("sign_accuracy"))
