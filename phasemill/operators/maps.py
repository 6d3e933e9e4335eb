"""Retinotopic maps from complex maps: delay, position, gradients, field sign, magnification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.functions.columns import phase_to_degrees, safe_div, wrap_principal
from phasemill.operators import stencil
from phasemill.session import join_small

REC = ["rec_id"]
PIX = ["rec_id", "height", "width", "y", "x"]
ORIENTATIONS = ("azi", "alt")


def rot90(df: DataFrame, k: int | str) -> DataFrame:
    """Quarter turns, clockwise on screen (row axis down); swaps the frame size for odd k."""
    turn = F.pmod(F.lit(k) if isinstance(k, int) else F.col(k), F.lit(4))
    y, x, h, w = (F.col(c) for c in ("y", "x", "height", "width"))

    def pick(a, b, c, d):
        return F.when(turn == 1, b).when(turn == 2, c).when(turn == 3, d).otherwise(a)

    rest = [c for c in df.columns if c not in ("y", "x", "height", "width")]
    return df.select(
        *rest, pick(h, w, h, w).alias("height"), pick(w, h, w, h).alias("width"),
        pick(y, x, h - 1 - y, w - 1 - x).alias("y"), pick(x, h - 1 - y, w - 1 - x, y).alias("x"),
    )


def pair_directions(maps: DataFrame) -> DataFrame:
    """One row per pixel with the four complex maps side by side (a conditional aggregation, no self join)."""
    aggs = []
    for o in ORIENTATIONS:
        for d in ("fwd", "rev"):
            hit = F.col("direction") == f"{o}_{d}"
            aggs += [F.max(F.when(hit, F.col(c))).alias(f"{o}_{d}_{c}") for c in ("re", "im")]
    return maps.groupBy(*PIX).agg(*aggs)


def _arg(p: str) -> Column:
    return F.atan2(F.col(f"{p}_im"), F.col(f"{p}_re"))


def _abs(p: str) -> Column:
    re, im = F.col(f"{p}_re"), F.col(f"{p}_im")
    return F.sqrt(re * re + im * im)


def delay(o: str) -> Column:
    """Mean angle of the two sweep directions, moved into (0, π]; exactly 0 becomes π/2."""
    f, r = _arg(f"{o}_fwd"), _arg(f"{o}_rev")
    d = F.atan2(F.sin(f) + F.sin(r), F.cos(f) + F.cos(r))
    return d + (F.lit(1.0) - F.signum(d)) * (math.pi / 2)


def position_amplitude(o: str) -> Column:
    return (_abs(f"{o}_fwd") + _abs(f"{o}_rev")) / 2.0


def combine_directions(pairs: DataFrame, method: str = "delay_subtracted") -> DataFrame:
    """Per orientation: unit position phasor, amplitude, delay (null when the method has none)."""
    out = [F.col(c) for c in PIX]
    for o in ORIENTATIONS:
        if method == "delay_subtracted":
            d = delay(o)
            half = (wrap_principal(_arg(f"{o}_fwd") - d) - wrap_principal(_arg(f"{o}_rev") - d)) / 2.0
            re, im = F.cos(half), F.sin(half)
        elif method == "forward_only":
            d = F.lit(None).cast("double")
            re, im = F.col(f"{o}_fwd_re"), F.col(f"{o}_fwd_im")
        else:
            raise ValueError(f"unknown combination {method!r}")
        out += [re.alias(f"{o}_re"), im.alias(f"{o}_im"), d.alias(f"{o}_delay"), position_amplitude(o).alias(f"{o}_amp")]
    return pairs.select(*out)


def phase_gradients(df: DataFrame) -> DataFrame:
    """Adds d_azi_dx, d_azi_dy, d_alt_dx, d_alt_dy (radians per pixel) from the position phasors."""
    g = stencil.gradient(df, ["azi_re", "azi_im", "alt_re", "alt_im"])

    def grad(o, axis):
        c, s = F.col(f"{o}_re"), F.col(f"{o}_im")
        dc, ds = F.col(f"{o}_re_{axis}"), F.col(f"{o}_im_{axis}")
        return (c * ds - s * dc) / F.greatest(c * c + s * s, F.lit(1e-12))

    new = {f"d_{o}_{axis}": grad(o, axis) for o in ORIENTATIONS for axis in ("dx", "dy")}
    drop = [f"{o}_{p}_{a}" for o in ORIENTATIONS for p in ("re", "im") for a in ("dx", "dy")]
    return g.withColumns(new).drop(*drop)


def field_sign() -> Column:
    alt = F.atan2(F.col("d_alt_dy"), F.col("d_alt_dx"))
    azi = F.atan2(F.col("d_azi_dy"), F.col("d_azi_dx"))
    return F.sin(alt - azi)


def field_sign_from_positions(df: DataFrame, azi: str, alt: str, name: str = "sign") -> DataFrame:
    """The position-map form; the order of the angles is the opposite of `field_sign`."""
    g = stencil.gradient(df, [azi, alt])
    a = F.atan2(F.col(f"{azi}_dy"), F.col(f"{azi}_dx"))
    b = F.atan2(F.col(f"{alt}_dy"), F.col(f"{alt}_dx"))
    return g.withColumn(name, F.sin(a - b)).drop(f"{azi}_dx", f"{azi}_dy", f"{alt}_dx", f"{alt}_dy")


def jacobian_det() -> Column:
    return F.col("d_azi_dx") * F.col("d_alt_dy") - F.col("d_azi_dy") * F.col("d_alt_dx")


def magnification(azi_range: Column | float, alt_range: Column | float) -> Column:
    """|det J| scaled from radians² to degrees² per pixel."""

    def c(v):
        return v if isinstance(v, Column) else F.lit(float(v))

    two_pi = 2.0 * math.pi
    return F.abs(jacobian_det()) * (c(azi_range) / two_pi) * (c(alt_range) / two_pi)


def anisotropy() -> tuple[Column, Column]:
    """Axis in [0, 180) and distortion in [0, 1] from the doubled-angle, magnitude-weighted resultant."""

    def polar(o):
        dx, dy = F.col(f"d_{o}_dx"), F.col(f"d_{o}_dy")
        return F.atan2(dy, dx), F.sqrt(dx * dx + dy * dy)

    (t1, m1), (t2, m2) = polar("azi"), polar("alt")
    # each angle is taken a quarter turn on, so doubling it flips the sign of both terms
    rc = -(m1 * F.cos(t1 * 2) + m2 * F.cos(t2 * 2))
    rs = -(m1 * F.sin(t1 * 2) + m2 * F.sin(t2 * 2))
    axis = F.pmod(F.degrees(F.atan2(rs, rc) / 2.0), F.lit(180.0))
    dist = safe_div(F.sqrt(rc * rc + rs * rs), m1 + m2)
    return axis, dist


def smooth_directions(maps: DataFrame, method: str = "none", sigma: float = 0.0) -> DataFrame:
    """Smooth each direction's complex map before combining."""
    keys = ["rec_id", "direction"]
    if method == "none" or sigma <= 0:
        return maps
    if method == "gaussian":
        return stencil.gaussian_smooth(maps, ["re", "im"], sigma, keys)
    if method == "adaptive":
        return stencil.adaptive_smooth(maps, ["re", "im"], sigma, keys)
    raise ValueError(f"unknown direction smoothing {method!r}")


def smooth_positions(pos: DataFrame, method: str, sigma: float) -> DataFrame:
    """Both orientations in one filter: two exchanges and one join for all their planes."""
    planes = {}
    for o in ORIENTATIONS:
        re, im = F.col(f"{o}_re"), F.col(f"{o}_im")
        if method == "amplitude":
            a = F.col(f"{o}_amp")
            planes |= {f"_{o}_re": re * a, f"_{o}_im": im * a, f"_{o}_a": a}
        else:
            planes |= {f"_{o}_t": F.atan2(im, re)}
    soft = stencil.gaussian_smooth(pos.select(*PIX, *[c.alias(n) for n, c in planes.items()]), list(planes), sigma)
    out = {}
    for o in ORIENTATIONS:
        if method == "amplitude":
            den = F.greatest(F.col(f"_{o}_a"), F.lit(1e-10))
            out |= {f"{o}_re": F.col(f"_{o}_re") / den, f"{o}_im": F.col(f"_{o}_im") / den}
        else:
            out |= {f"{o}_re": F.cos(f"_{o}_t"), f"{o}_im": F.sin(f"_{o}_t")}
    rest = pos.drop(*out)
    return rest.join(soft.select(*PIX, *[c.alias(n) for n, c in out.items()]), PIX)


def retinotopy(
    maps: DataFrame, recordings: DataFrame | None = None, *, azi_range: float = 100.0, alt_range: float = 100.0,
    offset_azi: float = 0.0, offset_alt: float = 0.0, rotation_k: int = 0, direction_smoothing: str = "none",
    direction_sigma: float = 0.0, combine: str = "delay_subtracted", position_smoothing: str = "amplitude",
    position_sigma: float = 0.0, sign_sigma: float = 0.0,
) -> DataFrame:
    """All retinotopic leaves per pixel. With `recordings`, geometry and rotation come from its columns."""
    geo = ["azi_range", "alt_range", "offset_azi", "offset_alt"]
    if recordings is not None:
        g = recordings.select("rec_id", *geo, "rotation_k")
        maps = rot90(join_small(maps, g.select("rec_id", "rotation_k"), REC), "rotation_k").drop("rotation_k")
    elif rotation_k % 4:
        maps = rot90(maps, rotation_k)
    maps = smooth_directions(maps, direction_smoothing, direction_sigma)
    pos = combine_directions(pair_directions(maps), combine)
    if position_sigma > 0:
        pos = smooth_positions(pos, position_smoothing, position_sigma)
    out = phase_gradients(pos)
    if recordings is not None:
        out = join_small(out, g.drop("rotation_k"), REC)
    else:
        for n, v in zip(geo, (azi_range, alt_range, offset_azi, offset_alt)):
            out = out.withColumn(n, F.lit(float(v)))
    axis, distortion = anisotropy()
    out = out.withColumns(
        {
            "azi_phase": F.atan2("azi_im", "azi_re"),
            "alt_phase": F.atan2("alt_im", "alt_re"),
            "vfs": field_sign(),
            "determinant": magnification(F.col("azi_range"), F.col("alt_range")),
            "axis_deg": axis,
            "distortion": distortion,
        }
    )
    out = out.withColumns(
        {
            "azi_deg": phase_to_degrees("azi_phase", "azi_range", "offset_azi"),
            "alt_deg": phase_to_degrees("alt_phase", "alt_range", "offset_alt"),
            "azi_delay_deg": F.degrees("azi_delay"),
            "alt_delay_deg": F.degrees("alt_delay"),
        }
    )
    if sign_sigma > 0:
        sm = stencil.gaussian_smooth(out, ["vfs"], sign_sigma).withColumnRenamed("vfs", "vfs_smooth")
        out = out.join(sm, PIX)
    else:
        out = out.withColumn("vfs_smooth", F.col("vfs"))
    return out.drop(*geo)
