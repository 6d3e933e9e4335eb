"""Scalar column expressions: normalisation, complex algebra, angles, geometry.

Everything here is a pure `Column -> Column` function, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi

# Label prefix -> direction, in matching order ("ccw" must precede "cw").
DIRECTION_PREFIXES = [
    ("lr", "azi_fwd"),
    ("rl", "azi_rev"),
    ("tb", "alt_fwd"),
    ("bt", "alt_rev"),
    ("ccw", "azi_rev"),
    ("cw", "azi_fwd"),
    ("expand", "alt_fwd"),
    ("contract", "alt_rev"),
]

# Stimulus state id -> name.
STATE_NAMES = {
    0: "idle",
    1: "baseline_start",
    2: "stimulus",
    3: "inter_stimulus",
    4: "inter_direction",
    5: "baseline_end",
    6: "complete",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round for comparison across engines; adding 0.0 turns -0.0 into 0.0."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """IEEE division: x/0 is ±inf and 0/0 is NaN, whether or not the session is in ANSI mode."""
    a, b = col(a), col(b)
    return (
        F.when(b != 0.0, F.try_divide(a, b))
        .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(a) | (a == 0.0), F.lit(float("nan")))
        .when(a > 0.0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )


def finite(c: str | Column) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def classify_direction(label: str | Column) -> Column:
    low = F.lower(col(label))
    out = None
    for prefix, name in DIRECTION_PREFIXES:
        hit = low.startswith(prefix)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def state_name(state_id: str | Column) -> Column:
    out = None
    for sid, name in STATE_NAMES.items():
        hit = col(state_id) == sid
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def normalize(v, f0, floor, method: str = "fractional") -> Column:
    v, f0, floor = col(v), col(f0), col(floor)
    if method == "absolute":
        return v - f0
    if method == "fractional":
        return safe_div(v - f0, F.greatest(f0, floor))
    raise ValueError(f"unknown normalisation {method!r}")


def rectify(v, method: str = "none") -> Column:
    v = col(v)
    if method == "none":
        return v
    if method == "half_wave":
        return F.greatest(v, F.lit(0.0))
    raise ValueError(f"unknown rectification {method!r}")


# ---- complex numbers as two DOUBLE columns -------------------------------------------------


def c_abs(re, im) -> Column:
    re, im = col(re), col(im)
    return F.sqrt(re * re + im * im)


def c_arg(re, im) -> Column:
    return F.atan2(col(im), col(re))


def c_from_phase(phi) -> tuple[Column, Column]:
    phi = col(phi)
    return F.cos(phi), F.sin(phi)


def c_from_polar(mag, phi) -> tuple[Column, Column]:
    mag, phi = col(mag), col(phi)
    return mag * F.cos(phi), mag * F.sin(phi)


def c_rotate(re, im, angle) -> tuple[Column, Column]:
    re, im, angle = col(re), col(im), col(angle)
    c, s = F.cos(angle), F.sin(angle)
    return re * c - im * s, re * s + im * c


def c_scale(re, im, k) -> tuple[Column, Column]:
    return col(re) * col(k), col(im) * col(k)


# ---- angles ---------------------------------------------------------------------------------


def wrap_principal(phi) -> Column:
    phi = col(phi)
    return F.atan2(F.sin(phi), F.cos(phi))


def wrap_distance(a, b, period) -> Column:
    p = period if isinstance(period, Column) else F.lit(float(period))
    d = F.pmod(col(a) - col(b), p)
    return F.least(d, p - d)


def phase_to_degrees(phi, angular_range, offset) -> Column:
    return col(phi) * col(angular_range) / F.lit(TWO_PI) + col(offset)


def ecc_alt(alt, azi, alt_c, azi_c) -> Column:
    da = F.radians(col(alt) - col(alt_c))
    dz = F.radians(col(azi) - col(azi_c))
    cos2 = F.greatest(F.cos(da) * F.cos(da), F.lit(1e-12))
    t, z = F.tan(da), F.tan(dz)
    return F.degrees(F.atan(F.sqrt(t * t + z * z / cos2)))


def ecc_azi(alt, azi, alt_c, azi_c) -> Column:
    da = F.radians(col(alt) - col(alt_c))
    dz = F.radians(col(azi) - col(azi_c))
    t, z = F.tan(da), F.tan(dz)
    return F.degrees(F.atan(F.sqrt(z * z + safe_div(t * t, F.cos(dz) * F.cos(dz)))))


def polar_angle(alt, azi, alt_c, azi_c) -> Column:
    return F.degrees(F.atan2(col(alt) - col(alt_c), col(azi) - col(azi_c)))


def label_roi(value, label) -> Column:
    return F.when(col(label) > 0, col(value)).otherwise(F.lit(0.0))


def magnification_factor(det, label) -> Column:
    inv = F.lit(1.0) / F.greatest(F.nanvl(col(det).cast("double"), F.lit(1e-12)), F.lit(1e-12))
    return F.when(col(label) > 0, inv).otherwise(F.lit(0.0))


def display_fraction(value, lo, hi, wrap_period, zero_means) -> Column:
    """Position on the colour axis; null where the value is a sentinel or not finite."""
    v, lo, hi, p = col(value), col(lo), col(hi), col(wrap_period)
    linear = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), (v - lo) / F.greatest(hi - lo, F.lit(1e-10)))
    )
    circular = F.pmod(v - lo, F.when(p > 0, p)) / F.when(p > 0, p)
    hidden = ~finite(v) | (F.coalesce(F.length(col(zero_means)) > 0, F.lit(False)) & (v == 0.0))
    return F.when(hidden, F.lit(None).cast("double")).when(p > 0, circular).otherwise(linear)


# ---- stimulus and screen geometry -----------------------------------------------------------


def bar_position(state_id, label, progress, extent, width, center) -> Column:
    """Commanded sweep angle in degrees, single precision like the display; NaN with no bar shown."""

    def f32(c):
        return col(c).cast("float")

    half = F.lit(0.5).cast("float")
    reach = f32(extent) * half + f32(width) * half
    travelled = f32(progress) * (f32(extent) + f32(width))
    rising = col(label).isin("LR", "BT")
    along = F.when(rising, travelled - reach).otherwise(reach - travelled)
    shown = (col(state_id) == 2) & col(label).isin("LR", "RL", "TB", "BT")
    return F.when(shown, (f32(center) + along).cast("double")).otherwise(F.lit(float("nan")))


class Screen:
    """A flat or curved screen described by columns (or literals), in cm, px and degrees."""

    def __init__(self, projection, distance, width_cm, height_cm, width_px=None, height_px=None,
                 azi0=0.0, alt0=0.0, bisector_x=0.0, bisector_y=0.0):
        def c(v):
            return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)

        self.projection, self.d = c(projection), c(distance)
        self.w, self.h = c(width_cm), c(height_cm)
        self.wpx = None if width_px is None else c(width_px)
        self.hpx = None if height_px is None else c(height_px)
        self.azi0, self.alt0, self.bx, self.by = c(azi0), c(alt0), c(bisector_x), c(bisector_y)
        self._curved = self.projection == "cylindrical"
        self._ball = self.projection == "spherical"

    def field_width(self) -> Column:
        flat = F.degrees(F.atan(self.w / 2.0 / self.d)) * 2.0
        return F.when(self._curved, F.degrees(self.w / self.d)).otherwise(flat)

    def field_height(self) -> Column:
        return F.degrees(F.atan(self.h / 2.0 / self.d)) * 2.0

    def _offsets(self, u, v):
        """Signed cm from the bisector foot: right and up positive."""
        return (u - 0.5) * self.w - self.bx, (F.lit(0.5) - v) * self.h - self.by

    def to_angle(self, u, v) -> tuple[Column, Column]:
        """Normalised screen position (0,0 = top left) to azimuth and elevation degrees."""
        right, up = self._offsets(col(u), col(v))
        azi = F.when(self._curved, F.degrees(right / self.d)).otherwise(
            F.degrees(F.atan(right / self.d))
        )
        slant = F.sqrt(self.d * self.d + right * right + up * up)
        alt = F.when(self._ball, F.degrees(F.asin(up / slant))).otherwise(
            F.degrees(F.atan(up / self.d))
        )
        return azi + self.azi0, alt + self.alt0

    def to_screen(self, azi, alt) -> tuple[Column, Column]:
        """Inverse of `to_angle`."""
        a, e = F.radians(col(azi) - self.azi0), F.radians(col(alt) - self.alt0)
        right = F.when(self._curved, self.d * a).otherwise(self.d * F.tan(a))
        ground = F.when(self._ball, F.sqrt(self.d * self.d + right * right)).otherwise(self.d)
        up = ground * F.tan(e)
        return (right + self.bx) / self.w + 0.5, F.lit(0.5) - (up + self.by) / self.h

    def to_angle_px(self, px, py) -> tuple[Column, Column]:
        return self.to_angle(col(px) / self.wpx, col(py) / self.hpx)

    def to_screen_px(self, azi, alt) -> tuple[Column, Column]:
        u, v = self.to_screen(azi, alt)
        return u * self.wpx, v * self.hpx

    def deg_to_px(self, deg, horizontal: bool = True) -> Column:
        if horizontal:
            return col(deg) / self.field_width() * self.wpx
        return col(deg) / self.field_height() * self.hpx

    def px_to_deg(self, px, horizontal: bool = True) -> Column:
        if horizontal:
            return col(px) / self.wpx * self.field_width()
        return col(px) / self.hpx * self.field_height()

    def max_eccentricity(self) -> Column:
        """Largest corner distance from the gaze centre."""
        cz, ce = F.tan(F.radians(self.azi0)) * self.d, F.tan(F.radians(self.alt0)) * self.d
        corners = []
        for u in (0.0, 1.0):
            for v in (0.0, 1.0):
                right, up = self._offsets(F.lit(u), F.lit(v))
                radial = F.sqrt((right - cz) * (right - cz) + (up - ce) * (up - ce))
                corners.append(F.degrees(F.atan2(radial, self.d)))
        return F.greatest(F.lit(0.0), *corners)


def sweep_duration(envelope, width, bar_speed, turn_speed, ring_speed, field, max_ecc) -> Column:
    """Seconds per sweep by envelope: bar, wedge, ring; a full-field flash has none."""
    env = col(envelope)
    return (
        F.when(env == "bar", safe_div(col(field) + col(width), bar_speed))
        .when(env == "wedge", safe_div(F.lit(360.0), turn_speed))
        .when(env == "ring", safe_div(col(max_ecc) + col(width), ring_speed))
        .when(env == "fullfield", F.lit(0.0))
    )


def session_duration(sweep_sec, n_conditions, n_reps, inter_stim, inter_dir, lead, tail) -> Column:
    s, nc, nr = col(sweep_sec), col(n_conditions), col(n_reps)
    trials = nc * nr
    gaps = F.greatest(trials - 1, F.lit(0)) * col(inter_stim)
    turns = F.greatest(nc - 1, F.lit(0)) * col(inter_dir) * nr
    return col(lead) + trials * s + gaps + turns + col(tail)


def um_per_pixel(diameter_mm, radius_px) -> Column:
    return safe_div(col(diameter_mm) * 1000.0, col(radius_px) * 2.0)
