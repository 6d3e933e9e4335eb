"""The whole analysis for many recordings at once: movies and schedules in, maps and areas out.

Every stage is a method looked up in `operators.manifest`, so that a registered one takes part under its name.
What a method of a stage gets and gives:

    baseline          (rows, sweeps) -> rec_id, height, width, y, f0 (an array per image row)
    projection        (rows, sweeps, baseline, settings) -> cycle maps, response quality or None
    retinotopy        (directions, recordings, settings) -> leaves per pixel
    sign_smoothing    (leaves, recordings, settings) -> pixels with vfs_smooth
    cortex_source     (leaves, **cortex_params) -> mask
    patch_threshold   (leaves, cortex, **threshold_params) -> mask, threshold per recording
    patch_extraction  (mask, leaves, **extraction) -> patch pixels
    patch_refinement  (patches, leaves, recordings, **refinement_params) -> patch pixels
    labels            (leaves, patches) -> pixels with label, sign, border
    eccentricity      (labelled leaves) -> them with eccentricity, polar
    derived_maps      (labelled leaves, cortex, threshold) -> them with the derived maps
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.operators import areas, manifest, maps, project, refine, stencil
from phasemill.session import cut, join_small, size_broadcasts_at_runtime

PIX = ["rec_id", "height", "width", "y", "x"]
AT = ["rec_id", "y", "x"]
BASELINES = ("rest_mean", "all_mean", "rest_median", "all_median")


@dataclass
class Settings:
    """One method and its tunables per stage."""

    baseline: str = "rest_mean"
    projection: str = "bin1"
    normalization: str = "fractional"
    rectification: str = "none"
    cycle_average: str = "simple"
    noise_bins: int | None = 20  # bins that the noise of the SNR is averaged over; None takes all
    retinotopy: str = "standard"
    direction_smoothing: str = "none"
    direction_sigma: float = 0.0
    combine: str = "delay_subtracted"
    position_smoothing: str = "amplitude"
    position_sigma: float = 1.0
    sign_smoothing: str = "gaussian"
    sign_sigma_um: float = 60.0
    cortex: str = "sigma_bound"
    cortex_params: dict = field(default_factory=dict)
    threshold: str = "sigma"
    threshold_params: dict = field(default_factory=dict)
    extraction_method: str = "borders"
    extraction: dict = field(default_factory=dict)
    refinement: str = "split_merge"
    refinement_params: dict = field(default_factory=dict)
    labels: str = "by_area"
    eccentricity: str = "visual_mean"
    derived: str = "standard"


@dataclass
class Analysis:
    """The stored results: direction maps, per-pixel leaves, patch pixels, response quality."""

    direction_maps: DataFrame
    pixel_maps: DataFrame
    patches: DataFrame
    responsiveness: DataFrame | None = None  # z-score and SNR per orientation, where a movie was given


# ---- the built-in methods ---------------------------------------------------------------------------


def _bin1(rows: DataFrame, sweeps: DataFrame, baseline, s: Settings) -> tuple[DataFrame, DataFrame | None]:
    return project.movie_maps(rows, sweeps, baseline, s.normalization, s.rectification, True, s.noise_bins)


def _retinotopy(directions: DataFrame, recordings: DataFrame, s: Settings) -> DataFrame:
    return maps.retinotopy(
        directions, recordings, direction_smoothing=s.direction_smoothing, direction_sigma=s.direction_sigma,
        combine=s.combine, position_smoothing=s.position_smoothing, position_sigma=s.position_sigma,
    ).drop("vfs_smooth")


def _soft_sign(leaves: DataFrame, recordings: DataFrame, s: Settings) -> DataFrame:
    signs = leaves.select(*PIX, F.col("vfs").alias("vfs_smooth"))
    return stencil.smooth_um(join_small(signs, recordings.select("rec_id", "um_per_pixel"), "rec_id"), ["vfs_smooth"], s.sign_sigma_um)


def _split_fuse(patches: DataFrame, leaves: DataFrame, recordings: DataFrame, **params) -> DataFrame:
    scale = {"um_per_pixel": recordings.select("rec_id", "um_per_pixel")}
    return refine.split_fuse(patches, leaves, **(scale | params))


def _eccentricity(labelled: DataFrame, method: str) -> DataFrame:
    return areas.eccentricity(labelled, "alt_deg", "azi_deg", method)


manifest.register_method("projection", "bin1", _bin1)
manifest.register_method("retinotopy", "standard", _retinotopy)
manifest.register_method("sign_smoothing", "gaussian", _soft_sign)
for _name in ("none", "reliability", "magnitude", "sigma_bound"):
    manifest.register_method("cortex_source", _name, partial(areas.cortex_mask, method=_name))
for _name in ("fixed", "sigma"):
    manifest.register_method("patch_threshold", _name, partial(areas.patch_threshold, method=_name))
manifest.register_method("patch_extraction", "borders", areas.extract_patches)
manifest.register_method("patch_refinement", "none", lambda patches, leaves, recordings: patches)
manifest.register_method(
    "patch_refinement", "split_merge", lambda patches, leaves, recordings, **p: refine.split_merge(patches, leaves, **p)
)
manifest.register_method("patch_refinement", "split_fuse", _split_fuse)
manifest.register_method("labels", "by_area", areas.assemble_labels)
for _name in ("visual_mean", "pixel_sample"):
    manifest.register_method("eccentricity", _name, partial(_eccentricity, method=_name))
manifest.register_method("derived_maps", "standard", areas.derived_maps)


# ---- stages -------------------------------------------------------------------------------------------


def _projection(rows: DataFrame, sweeps: DataFrame, s: Settings) -> dict[str, DataFrame]:
    baseline = s.baseline if s.baseline in BASELINES else manifest.method("baseline", s.baseline)(rows, sweeps)
    cycles, quality = manifest.method("projection", s.projection)(rows, sweeps, baseline, s)
    cycles = cut(cycles)
    found = {"directions": project.cycle_average(cycles, s.cycle_average), "reliability": project.reliability(cycles)}
    return found if quality is None else found | {"quality": quality}


def _leaves(directions: DataFrame, reliability: DataFrame | None, recordings: DataFrame, s: Settings) -> DataFrame:
    retino = manifest.method("retinotopy", s.retinotopy)(directions, recordings, s)
    if reliability is not None:
        turned = maps.rot90(join_small(reliability, recordings.select("rec_id", "rotation_k"), "rec_id"), "rotation_k")
        wide = turned.groupBy(*AT).agg(
            *[
                F.max(F.when(F.col("direction") == d, F.col("reliability"))).alias(f"rel_{d}")
                for d in ("azi_fwd", "azi_rev", "alt_fwd", "alt_rev")
            ]
        )
        retino = retino.join(wide, AT, "left")
    return retino.withColumn("magnitude", (F.col("azi_amp") + F.col("alt_amp")) / 2.0)


def _sign(leaves: DataFrame, recordings: DataFrame, s: Settings) -> DataFrame:
    return manifest.method("sign_smoothing", s.sign_smoothing)(leaves, recordings, s).select(*PIX, "vfs_smooth")


def _cortex(leaves: DataFrame, s: Settings) -> DataFrame:
    return manifest.method("cortex_source", s.cortex)(leaves, **s.cortex_params)


def _threshold(leaves: DataFrame, cortex: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    return manifest.method("patch_threshold", s.threshold)(leaves, cortex, **s.threshold_params)


def _extraction(mask: DataFrame, leaves: DataFrame, s: Settings) -> DataFrame:
    return manifest.method("patch_extraction", s.extraction_method)(mask, leaves, **s.extraction).select(*PIX, "patch", "sign")


def _refinement(patches: DataFrame, leaves: DataFrame, recordings: DataFrame, s: Settings) -> DataFrame:
    return manifest.method("patch_refinement", s.refinement)(patches, leaves, recordings, **s.refinement_params)


def _labels(leaves: DataFrame, patches: DataFrame, s: Settings) -> DataFrame:
    return manifest.method("labels", s.labels)(leaves, patches).select(*AT, "label", "sign", "border")


def _centric(labelled: DataFrame, s: Settings) -> DataFrame:
    return manifest.method("eccentricity", s.eccentricity)(labelled).select(*AT, "eccentricity", "polar")


DERIVED = ["magnification", "contours_azi", "contours_alt", "vfs_thresholded"]


def _derived(labelled: DataFrame, cortex: DataFrame, threshold: DataFrame, s: Settings) -> DataFrame:
    return manifest.method("derived_maps", s.derived)(labelled, cortex, threshold).select(*AT, *DERIVED)


def _pixel_maps(labelled: DataFrame, centric: DataFrame, derived: DataFrame, cortex: DataFrame) -> DataFrame:
    inside = cortex.select(*AT, F.lit(True).alias("_in"))
    full = labelled.join(centric, AT).join(derived, AT).join(inside, AT, "left")
    return full.withColumn("cortex", F.coalesce("_in", F.lit(False))).drop("_in")


# ---- plans ----------------------------------------------------------------------------------------------


def analyze(recordings: DataFrame, rows: DataFrame, sweeps: DataFrame, s: Settings | None = None) -> Analysis:
    """`recordings` carries the geometry columns of `sources.lake.parse_acquisition` under their short names.

    The movie is scanned once, for the maps and for the response quality, or twice with rectification.
    """
    s = s or Settings()
    size_broadcasts_at_runtime(rows.sparkSession)
    found = _projection(rows, sweeps, s)
    out = analyze_maps(recordings, cut(found["directions"]), s, found["reliability"])
    out.responsiveness = found.get("quality")
    return out


def analyze_maps(
    recordings: DataFrame, directions: DataFrame, s: Settings | None = None, reliability: DataFrame | None = None
) -> Analysis:
    """The part of the analysis that starts from complex maps."""
    s = s or Settings()
    retino = cut(_leaves(directions, reliability, recordings, s))
    leaves = cut(retino.join(_sign(retino, recordings, s), PIX))
    cortex = cut(_cortex(leaves, s))
    mask, threshold = _threshold(leaves, cortex, s)
    patches = cut(_refinement(cut(_extraction(cut(mask), leaves, s)), leaves, recordings, s))
    labelled = cut(leaves.join(_labels(leaves, patches, s), AT))
    pixels = _pixel_maps(labelled, _centric(labelled, s), _derived(labelled, cortex, cut(threshold), s), cortex)
    return Analysis(directions, pixels, patches)


def parameters(recordings: DataFrame, s: Settings) -> DataFrame:
    """The parameter strings that `manifest.stage_fingerprints` takes, one row per recording.

    A recording is what its `raw_identity` says, if there is such a column (a content hash, a path and time), else its id.
    """
    v = asdict(s)

    def of(*names: str):
        return F.lit(json.dumps({n: v[n] for n in names}, sort_keys=True))

    identity = F.col("raw_identity") if "raw_identity" in recordings.columns else F.col("rec_id").cast("string")
    geometry = F.to_json(F.struct("azi_range", "alt_range", "offset_azi", "offset_alt", "rotation_k"))
    said = {
        "baseline": of("baseline"), "raw_identity": identity, "response_normalization": of("normalization", "projection", "noise_bins"),
        "rectification": of("rectification"), "cycle_average": of("cycle_average"),
        "direction_smoothing": of("direction_smoothing", "direction_sigma"), "cycle_combine": of("combine"),
        "phase_smoothing": of("position_smoothing", "position_sigma"), "vfs_computation": of("retinotopy"), "geometry": geometry,
        "sign_map_smoothing": of("sign_smoothing", "sign_sigma_um"), "um_per_pixel": F.col("um_per_pixel").cast("string"),
        "cortex_source": of("cortex", "cortex_params"), "patch_threshold": of("threshold", "threshold_params"),
        "patch_extraction": of("extraction_method", "extraction"), "patch_refinement": of("refinement", "refinement_params", "labels"),
        "eccentricity": of("eccentricity", "derived"),
    }
    return recordings.select("rec_id", *[c.alias(n) for n, c in said.items()])


def analyze_stale(
    recordings: DataFrame, rows: DataFrame, sweeps: DataFrame, store: manifest.StageStore, s: Settings | None = None,
    params: DataFrame | None = None,
) -> tuple[Analysis, DataFrame]:
    """`analyze` into a store: each stage runs for the recordings it is stale for and is restored for the others.

    Returns the results of all given recordings, read from the store, and (rec_id, stage) of what ran. Movies are read
    for recordings whose projection is stale and for no others; if there are none, not at all. Patches are
    given as the labelled pixels, since patch stages are not stored. `params` overrides `parameters(recordings, s)`.
    """
    s = s or Settings()
    size_broadcasts_at_runtime(recordings.sparkSession)

    def some(df: DataFrame, like: DataFrame) -> DataFrame:
        return join_small(df, like.select("rec_id").distinct(), "rec_id", "left_semi")

    def leaves(of: manifest.Reader) -> DataFrame:
        return of("retinotopy", "leaves").join(of("sign_smoothing", "signs"), PIX)

    def labelled(of: manifest.Reader) -> DataFrame:
        return cut(leaves(of).join(of("labels", "labels"), AT))

    def projection(of: manifest.Reader) -> dict[str, DataFrame]:
        return _projection(some(rows, of.recs), some(sweeps, of.recs), s)

    def threshold(of: manifest.Reader) -> dict[str, DataFrame]:
        mask, value = _threshold(cut(leaves(of)), of("cortex_source", "cortex"), s)
        return {"mask": mask, "threshold": value}

    compute = {
        "projection": projection,
        "retinotopy": lambda of: {"leaves": _leaves(of("projection", "directions"), of("projection", "reliability"), recordings, s)},
        "sign_smoothing": lambda of: {"signs": _sign(of("retinotopy", "leaves"), recordings, s)},
        "cortex_source": lambda of: {"cortex": _cortex(cut(leaves(of)), s)},
        "patch_threshold": threshold,
        "patch_extraction": lambda of: {"raw_patches": _extraction(of("patch_threshold", "mask"), cut(leaves(of)), s)},
        "patch_refinement": lambda of: {"patches": _refinement(of("patch_extraction", "raw_patches"), cut(leaves(of)), recordings, s)},
        "labels": lambda of: {"labels": _labels(leaves(of), of("patch_refinement", "patches"), s)},
        "eccentricity": lambda of: {"centric": _centric(labelled(of), s)},
        "derived_maps": lambda of: {"derived": _derived(labelled(of), of("cortex_source", "cortex"), of("patch_threshold", "threshold"), s)},
    }
    ran = manifest.restore(store, manifest.stage_keys(parameters(recordings, s) if params is None else params), compute)

    def read(stage: str, name: str) -> DataFrame:
        return store.read(stage, name, recordings.select("rec_id"))

    full = leaves(read).join(read("labels", "labels"), AT)
    pixels = _pixel_maps(full, read("eccentricity", "centric"), read("derived_maps", "derived"), read("cortex_source", "cortex"))
    patches = full.filter("label > 0").select(*PIX, F.col("label").alias("patch"), "sign")
    return Analysis(read("projection", "directions"), pixels, patches, read("projection", "quality")), ran
