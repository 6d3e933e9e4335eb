"""Reading, checking, writing and migrating a lake of recordings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.functions.columns import c_from_polar, classify_direction
from phasemill.operators.blocks import block_of
from phasemill.operators.project import FRAME_BLOCK

REC = ["rec_id"]


# ---- readers ---------------------------------------------------------------------------------------


def load_recordings(spark: SparkSession, path: str) -> DataFrame:
    """The recording catalogue, newest first."""
    return newest_first(spark.read.parquet(path))


def newest_first(recordings: DataFrame) -> DataFrame:
    return recordings.orderBy(F.col("created_at").desc(), F.col("rec_id").desc())


def library_recent(recordings: DataFrame, n: int) -> DataFrame:
    return newest_first(recordings).limit(n)


def scan_folder(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Raw files with size and modification time; file contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return f.select("path", "length", F.col("modificationTime").alias("created_at")).orderBy(F.col("created_at").desc())


def load_frames(spark: SparkSession, path: str, rec_ids: Sequence | None = None) -> DataFrame:
    """Movie rows partitioned by rec_id; naming recordings prunes the other folders."""
    df = spark.read.parquet(path)
    return df if rec_ids is None else df.filter(F.col("rec_id").isin(list(rec_ids)))


def write_frames(rows: DataFrame, path: str) -> None:
    """Movie rows as `load_frames` reads them, a folder per recording.

    Ranges keep the frames of a recording together: few files each, and a large recording still gets several.
    """
    rows.repartitionByRange("rec_id", "frame_idx").write.partitionBy("rec_id").parquet(path)


def parse_schedule(df: DataFrame) -> DataFrame:
    """Sweeps from a JSON label list and two time arrays, cut to the shortest of the three."""
    labels = F.from_json("sweep_sequence", "array<string>")
    n = F.least(F.size(labels), F.size("sweep_start_sec"), F.size("sweep_end_sec"))
    z = F.arrays_zip(labels.alias("label"), F.col("sweep_start_sec"), F.col("sweep_end_sec"))
    return (
        df.select("rec_id", n.alias("_n"), F.posexplode(z).alias("sweep_idx", "_z"))
        .filter("sweep_idx < _n")
        .select(
            "rec_id", "sweep_idx", F.col("_z.label").alias("label"),
            F.col("_z.sweep_start_sec").alias("start_sec"), F.col("_z.sweep_end_sec").alias("end_sec"),
        )
    )


# Geometry fields with the value taken when the file has none
GEOMETRY_DEFAULTS = {
    "azi_angular_range": 100.0,
    "alt_angular_range": 100.0,
    "offset_azi": 0.0,
    "offset_alt": 0.0,
    "rotation_k": 0,
}
UM_PER_PIXEL_DEFAULT = 20.0


def parse_acquisition(df: DataFrame, rig: str = "rig_json", exp: str = "exp_json") -> DataFrame:
    """Geometry from the JSON attributes; absent fields are defaulted and named in `missing`."""
    kinds = {k: ("bigint" if isinstance(v, int) else "double") for k, v in GEOMETRY_DEFAULTS.items()}
    geo = "stimulus_geometry struct<" + ",".join(f"{k}:{t}" for k, t in kinds.items()) + ">"
    e = F.from_json(F.col(exp), geo)["stimulus_geometry"]
    um = F.from_json(F.col(rig), "camera struct<um_per_pixel:double>")["camera"]["um_per_pixel"]
    found = {k: e[k] for k in GEOMETRY_DEFAULTS} | {"um_per_pixel": um}
    defaults = GEOMETRY_DEFAULTS | {"um_per_pixel": UM_PER_PIXEL_DEFAULT}
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(k)) for k, c in found.items()]))
    out = df.withColumn("missing", missing)
    for k, c in found.items():
        out = out.withColumn(k, F.coalesce(c, F.lit(defaults[k])))
    level = (
        F.when(F.col(rig).isNull() & F.col(exp).isNull(), "defaulted")
        .when(F.size("missing") == 0, "full").otherwise("partial")
    )
    return out.withColumn("provenance", level)


def inspect(catalog: DataFrame, sweeps: DataFrame, maps: DataFrame, results: DataFrame) -> DataFrame:
    """What each recording offers: raw data, complex maps, results (with their leaf names), schedule."""
    cyc = (
        sweeps.withColumn("direction", classify_direction("label")).groupBy("rec_id", "direction")
        .agg(F.count(F.lit(1)).alias("_n")).groupBy("rec_id").agg(
            F.sum("_n").alias("n_sweeps"), F.count("direction").alias("n_directions"),
            F.min(F.when(F.col("direction").isNotNull(), F.col("_n"))).alias("cycles"),
        )
    )
    m = maps.groupBy("rec_id").agg(F.count(F.lit(1)).alias("_m"))
    leaf = F.array_sort(F.collect_set("leaf"))  # a fixed list of leaf names
    r = results.groupBy("rec_id").agg(leaf.alias("leaves"))
    j = catalog.join(cyc, REC, "left").join(m, REC, "left").join(r, REC, "left")
    return j.select(
        *catalog.columns, F.col("n_sweeps").isNotNull().alias("has_schedule"),
        F.col("_m").isNotNull().alias("has_maps"), F.col("leaves").isNotNull().alias("has_results"),
        "n_sweeps", "n_directions", "cycles", "leaves",
    )


def polar_import(df: DataFrame, mag: str = "mag", phase: str = "phase", direction: str = "direction") -> DataFrame:
    """Magnitude and phase per known direction to complex maps."""
    re, im = c_from_polar(mag, phase)
    known = ["azi_fwd", "azi_rev", "alt_fwd", "alt_rev"]
    rest = [c for c in df.columns if c not in (mag, phase)]
    return df.filter(F.col(direction).isin(known)).select(*rest, re.alias("re"), im.alias("im"))


# ---- writers ---------------------------------------------------------------------------------------


def write_movie(rows: DataFrame, table: str, buckets: int) -> DataFrame:
    """Store movie rows in buckets of (rec_id, frame block): schedules are then joined without moving a pixel."""
    placed = rows.withColumn(FRAME_BLOCK, block_of("frame_idx", 64))
    placed.write.bucketBy(buckets, "rec_id", FRAME_BLOCK).mode("overwrite").saveAsTable(table)
    return rows.sparkSession.table(table)


def write_maps(df: DataFrame, path: str) -> None:
    """One folder per recording; writing a recording again replaces it and nothing else.

    Rows are dealt by ranges: a recording is written by one task, or by neighbouring ones if it is large, not
    by all of them.
    """
    (
        df.repartitionByRange("rec_id", "y").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("rec_id").parquet(path)
    )


def read_map(spark: SparkSession, path: str, leaf: str) -> DataFrame:
    """One leaf of the stored maps; only its column is read."""
    return spark.read.parquet(path).select("rec_id", "y", "x", leaf)


def roi_rows(labels: DataFrame, signs: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Area membership as horizontal runs, so that a large area is never gathered into one row."""
    from pyspark.sql import Window

    w = Window.partitionBy("rec_id", "y").orderBy("x")
    a = labels.filter(F.col(label) > 0)
    new = F.when(
        (F.col("x") - F.lag("x").over(w) == 1) & (F.lag(label).over(w) == F.col(label)), 0
    ).otherwise(1)
    run = a.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    out = run.groupBy("rec_id", label, "y", "_run").agg(F.min("x").alias("x_first"), F.max("x").alias("x_last")).drop("_run")
    return out if signs is None else out.join(signs, ["rec_id", label], "left")


def sweep_rows(sweeps: DataFrame) -> DataFrame:
    """Interval table of the schedule."""
    return sweeps.select(
        "rec_id", "sweep_idx", "label", classify_direction("label").alias("direction"),
        F.col("start_sec").alias("start_time"), F.col("end_sec").alias("stop_time"),
    )


def forensics_rows(frames: DataFrame) -> DataFrame:
    """Per-frame timing evidence: hardware and system deltas and the counter step."""
    from phasemill.operators.timebase import frame_deltas

    return frame_deltas(
        frames,
        extra={
            "sys_delta": lambda w: F.col("sys_us") - F.lag("sys_us").over(w),
            "seq_step": lambda w: F.col("seq") - F.lag("seq").over(w),
        },
    ).select("rec_id", "frame_idx", F.col("delta").alias("hw_delta"), "sys_delta", "seq_step")


def export_tables(path: str, sweeps: DataFrame, labels: DataFrame, signs: DataFrame, frames: DataFrame) -> None:
    sweep_rows(sweeps).write.mode("overwrite").parquet(f"{path}/sweeps")
    roi_rows(labels, signs).write.mode("overwrite").parquet(f"{path}/rois")
    forensics_rows(frames).write.mode("overwrite").parquet(f"{path}/forensics")


# ---- migration and contract -------------------------------------------------------------------------


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    out = key
    for old, new in table.items():
        out = F.when(key == old, F.lit(new)).otherwise(out)
    return out


def _subtree(entries: Column, method: Column, table: Mapping[str, str]) -> Column:
    """Tunables of the active method's own object, under its old or new name."""
    hit = F.filter(entries, lambda e: e["value"].startswith("{") & (_lookup(e["key"], table) == method))
    return F.try_element_at(F.transform(hit, lambda e: F.from_json(e["value"], "map<string,double>")), F.lit(1))


def _without(tunables: Column, overrides: Column) -> Column:
    return F.map_filter(tunables, lambda k, v: ~F.array_contains(F.map_keys(overrides), k))


def migrate_params(
    df: DataFrame, params: str, stages: Mapping[str, tuple[str, Mapping[str, Mapping[str, float]]]],
    dropped: Sequence[str] = (), renames: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Old parameter JSON to one tagged row per recording and stage.

    `stages` maps a stage to its default method and the default tunables of each method. Output rows are
    (rec_id, stage, method, tunables MAP<STRING,DOUBLE>, unknown ARRAY<STRING>); a non-empty `unknown`
    means the record holds root keys that are neither stages nor known leftovers and must be rejected.
    """
    renames = renames or {}
    known = [*stages, *dropped]
    unknown = F.array_except(F.map_keys("_root"), F.array(*[F.lit(k) for k in known]))
    # each step is a projection of its own, so that no text is parsed again where its parts are used
    roots = df.select("rec_id", F.from_json(F.col(params), "map<string,string>").alias("_root"))
    olds = {stage: f"_old_{i}" for i, stage in enumerate(stages)}
    opened = roots.select(
        "rec_id", unknown.alias("unknown"),
        *[F.from_json(F.col("_root")[stage], "map<string,string>").alias(old) for stage, old in olds.items()],
    )
    empty = F.create_map().cast("map<string,double>")
    named, parts, rows = [], [], []
    for i, (stage, (default, trees)) in enumerate(stages.items()):
        old, method, nested, over = F.col(olds[stage]), F.col(f"_method_{i}"), F.col(f"_nested_{i}"), F.col(f"_over_{i}")
        table = renames.get(stage, {})
        named.append(F.coalesce(_lookup(old["method"], table), F.lit(default)).alias(f"_method_{i}"))
        entries = F.filter(F.map_entries(old), lambda e: e["key"] != "method")
        flat = F.map_from_entries(
            F.transform(
                F.filter(entries, lambda e: ~e["value"].startswith("{")),
                lambda e: F.struct(e["key"].alias("key"), e["value"].cast("double").alias("value")),
            )
        )
        parts.append(_subtree(entries, method, table).alias(f"_nested_{i}"))
        parts.append(F.coalesce(F.when(old["method"].isNotNull(), flat), empty).alias(f"_over_{i}"))
        base = empty
        for name, tree in trees.items():
            pairs = [x for k, v in tree.items() for x in (F.lit(k), F.lit(float(v)))]
            base = F.when(method == name, F.create_map(*pairs)).otherwise(base)
        below = _without(F.coalesce(nested, base), over)
        rows.append(
            F.struct(F.lit(stage).alias("stage"), method.alias("method"), F.map_concat(below, over).alias("tunables"))
        )
    methods = [f"_method_{i}" for i in range(len(stages))]
    split = opened.select("*", *named).select("rec_id", "unknown", *methods, *parts)
    return split.select("rec_id", "unknown", F.explode(F.array(*rows)).alias("_r")).select(
        "rec_id", "_r.stage", "_r.method", "_r.tunables", "unknown"
    )


def schema_check(observed: DataFrame, contract: DataFrame) -> DataFrame:
    """Violations both ways: required entities absent, undeclared entities present, wrong types.

    `observed` is (rec_id, entity, dtype); `contract` is (entity, dtype, required).
    """
    # the contract is one row: a map of declared types, a list of required entities
    must = contract.filter("required").agg(F.collect_set("entity").alias("m")).scalar()
    declared = contract.agg(F.map_from_entries(F.collect_set(F.struct("entity", "dtype"))).alias("m")).scalar()
    # per recording only required entities are gathered, so the set is bounded by the contract
    seen = observed.groupBy("rec_id").agg(
        F.collect_set(F.when(F.array_contains(must, F.col("entity")), F.col("entity"))).alias("_seen")
    )
    absent = (
        seen.withColumn("_absent", F.array_except(must, "_seen"))
        .select("rec_id", F.explode("_absent").alias("entity"))
        .withColumn("violation", F.lit("missing"))
    )
    known = F.try_element_at(declared, F.col("entity"))
    extra = observed.filter(known.isNull()).select("rec_id", "entity", F.lit("undeclared").alias("violation"))
    wrong = observed.filter(known != F.col("dtype")).select("rec_id", "entity", F.lit("dtype").alias("violation"))
    return absent.unionByName(extra).unionByName(wrong)
