"""SQL twins of the views and of shared intermediate results, composed into one WITH clause."""

from __future__ import annotations

VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, body: str, needs: str = "") -> None:
    VIEWS[name] = (body, needs)


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][1].split():
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in order)
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body.lstrip()[len('WITH RECURSIVE'):]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH RECURSIVE {head},\n{body.lstrip()[len('WITH'):]}"
    return f"WITH RECURSIVE {head}\n{body}"


view(
    "v_trace",
    """SELECT p // 125 * 8 + part AS rec_id,
        CASE vec_id % 4 WHEN 0 THEN 'azi_fwd' WHEN 1 THEN 'azi_rev' WHEN 2 THEN 'alt_fwd' ELSE 'alt_rev' END AS direction,
        CAST((p % 125 - part * 15) // 5 AS INTEGER) AS y, CAST((p % 125 - part * 15) % 5 AS INTEGER) AS x,
        CAST(CASE part WHEN 7 THEN 4 ELSE 3 END AS INTEGER) AS height, 5 AS width,
        CAST(i // 16 AS INTEGER) AS cycle, CAST(i % 16 AS INTEGER) AS k,
        CAST(1000 AS DOUBLE) * (1 + CAST(embedding[i + 1] AS DOUBLE)) AS v
      FROM (SELECT *, vec_id // 4 AS p, least(vec_id // 4 % 125 // 15, 7) AS part FROM embeddings), range(64) t(i)""",
)
view(
    "v_movie",
    """SELECT rec_id, (CASE direction WHEN 'azi_fwd' THEN 0 WHEN 'azi_rev' THEN 1 WHEN 'alt_fwd' THEN 2 ELSE 3 END) * 64
          + cycle * 16 + k AS frame_idx, y, x, CAST(round(v) AS INTEGER) AS p
        FROM v_trace""",
    "v_trace",
)
view(
    "v_movie_sweeps",
    """SELECT rec_id, CAST(s AS INTEGER) AS sweep_idx, list_extract(['LR','RL','TB','BT'], s // 4 + 1) AS label,
          s * 16 * CAST(0.1 AS DOUBLE) AS start_sec, s * 16 * CAST(0.1 AS DOUBLE) + CAST(1.15 AS DOUBLE) AS end_sec
        FROM (SELECT DISTINCT vec_id // 4 // 125 * 8 + least(vec_id // 4 % 125 // 15, 7) AS rec_id FROM embeddings), range(16) t(s)""",
)
view(
    "v_raster",
    """SELECT vec_id // 500 * 8 + part AS rec_id, CAST(CASE part WHEN 7 THEN 8 ELSE 6 END AS INTEGER) AS height, 10 AS width,
        CAST((vec_id % 500 - part * 60) // 10 AS INTEGER) AS y, CAST((vec_id % 500 - part * 60) % 10 AS INTEGER) AS x,
        CAST(embedding[o + 1] AS DOUBLE) AS v, CAST(embedding[o + 2] AS DOUBLE) AS w,
        CAST(embedding[o + 3] AS DOUBLE) * 100 AS alt, CAST(embedding[o + 4] AS DOUBLE) * 100 AS azi,
        abs(CAST(embedding[o + 5] AS DOUBLE)) AS det, 1 - abs(CAST(embedding[o + 6] AS DOUBLE)) AS q,
        label
      FROM (SELECT *, least(vec_id % 500 // 60, 7) AS part, least(vec_id % 500 // 60, 7) * 8 AS o FROM embeddings)""",
)
view("v_mask", "SELECT rec_id, height, width, y, x FROM v_raster WHERE v > 0", "v_raster")
view(
    "v_stamps",
    """SELECT user_id AS rec_id, epoch_us(ts) AS hw_us, epoch_us(ts) + CAST(trunc(value * 100) AS BIGINT) AS sys_us,
        event_id AS seq, value, event_type,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx
      FROM events""",
)
view(
    "v_sweeps",
    """SELECT rec_id, frame_idx AS sweep_idx, label, hw_us / CAST(1e6 AS DOUBLE) AS start_sec,
        least(coalesce(nxt, hw_us + 21600000000), hw_us + 21600000000) / CAST(1e6 AS DOUBLE) AS end_sec
      FROM (SELECT *, CASE event_type WHEN 'click' THEN 'LR' WHEN 'view' THEN 'RL' WHEN 'signup' THEN 'TB'
              WHEN 'purchase' THEN 'BT' END AS label,
              lead(hw_us) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS nxt FROM v_stamps)
      WHERE label IS NOT NULL""",
    "v_stamps",
)
view("v_times", "SELECT rec_id, frame_idx, hw_us / CAST(1e6 AS DOUBLE) AS ts_sec FROM v_stamps", "v_stamps")
view(
    "v_geometry",
    """SELECT p_partkey AS rig_id,
        CASE p_partkey % 3 WHEN 0 THEN 'cartesian' WHEN 1 THEN 'spherical' ELSE 'cylindrical' END AS projection,
        CASE p_partkey % 4 WHEN 0 THEN 'bar' WHEN 1 THEN 'wedge' WHEN 2 THEN 'ring' ELSE 'fullfield' END AS envelope,
        CAST(p_size AS DOUBLE) AS speed, p_retailprice % CAST(40 AS DOUBLE) + 1 AS width_deg,
        CAST(p_partkey % 30 + 10 AS DOUBLE) AS distance, CAST(p_size + 20 AS DOUBLE) AS width_cm,
        CAST(p_size + 10 AS DOUBLE) AS height_cm, CAST(p_partkey % 7 AS DOUBLE) AS bisector_x,
        CAST(p_partkey % 5 AS DOUBLE) AS bisector_y, CAST(p_partkey % 11 - 5 AS DOUBLE) AS azi0,
        CAST(p_partkey % 13 - 6 AS DOUBLE) AS alt0, (p_partkey % 101) / CAST(101 AS DOUBLE) AS u,
        (p_partkey % 97) / CAST(97 AS DOUBLE) AS v
      FROM part""",
)

# ---- shared intermediate results -------------------------------------------------------------

view("v_f0", "SELECT rec_id, y, x, avg(v) AS f0 FROM v_trace GROUP BY ALL", "v_trace")
view(
    "v_floor",
    """SELECT rec_id, greatest(0.5 * list_extract(list_sort(list(f0)), CAST(ceil((count(*) - 1) / 2.0) AS BIGINT) + 1), CAST(1 AS DOUBLE)) AS floor
        FROM v_f0 GROUP BY rec_id""",
    "v_f0",
)
view(
    "v_samples",
    """SELECT t.* EXCLUDE (v), (v - f0) / greatest(f0, floor) AS v FROM v_trace t JOIN v_f0 USING (rec_id, y, x) JOIN v_floor USING (rec_id)""",
    "v_trace v_f0 v_floor",
)
view(
    "v_cyc",
    """SELECT rec_id, direction, cycle, height, width, y, x, sum(v * cos(-2 * pi() * k / 16)) AS re, sum(v * sin(-2 * pi() * k / 16)) AS im
        FROM v_samples GROUP BY ALL""",
    "v_samples",
)
view(
    "v_cm",
    "SELECT rec_id, direction, height, width, y, x, avg(re) AS re, avg(im) AS im FROM v_cyc GROUP BY ALL",
    "v_cyc",
)
view(
    "v_avgmovie",
    "SELECT rec_id, direction, height, width, y, x, k, avg(v) AS v FROM v_samples GROUP BY ALL",
    "v_samples",
)
view(
    "v_spectrum",
    """SELECT rec_id, direction, y, x, bin, sqrt(power(sum(v * cos(-2 * pi() * bin * k / 16)), 2) + power(sum(v * sin(-2 * pi() * bin * k / 16)), 2)) * 2 / 16 AS power
        FROM v_avgmovie, (SELECT CAST(b AS INTEGER) AS bin FROM range(16) t(b)) GROUP BY ALL""",
    "v_avgmovie",
)
view(
    "v_pairs",
    """SELECT rec_id, height, width, y, x, """
    + ", ".join(
        f"max(CASE WHEN direction = '{o}_{d}' THEN {c} END) AS {o}_{d}_{c}"
        for o in ("azi", "alt") for d in ("fwd", "rev") for c in ("re", "im")
    )
    + " FROM v_cm GROUP BY ALL",
    "v_cm",
)
def _combined(o: str) -> str:
    return (
        f"atan2(sin({o}_f) + sin({o}_r), cos({o}_f) + cos({o}_r)) AS {o}_d0"
    )


view(
    "v_position",
    """SELECT rec_id, height, width, y, x, """
    + ", ".join(
        f"cos({o}_h) AS {o}_re, sin({o}_h) AS {o}_im, {o}_delay, {o}_amp" for o in ("azi", "alt")
    )
    + " FROM (SELECT *, "
    + ", ".join(
        f"(atan2(sin({o}_f - {o}_delay), cos({o}_f - {o}_delay)) - atan2(sin({o}_r - {o}_delay), cos({o}_r - {o}_delay))) / 2 AS {o}_h"
        for o in ("azi", "alt")
    )
    + " FROM (SELECT *, "
    + ", ".join(f"{o}_d0 + pi() / 2 * (1 - sign({o}_d0)) AS {o}_delay" for o in ("azi", "alt"))
    + " FROM (SELECT *, "
    + ", ".join(_combined(o) for o in ("azi", "alt"))
    + " FROM (SELECT *, "
    + ", ".join(
        f"atan2({o}_fwd_im, {o}_fwd_re) AS {o}_f, atan2({o}_rev_im, {o}_rev_re) AS {o}_r, "
        f"(sqrt({o}_fwd_re*{o}_fwd_re + {o}_fwd_im*{o}_fwd_im) + sqrt({o}_rev_re*{o}_rev_re + {o}_rev_im*{o}_rev_im)) / 2 AS {o}_amp"
        for o in ("azi", "alt")
    )
    + " FROM v_pairs))))",
    "v_pairs",
)


def gradient_sql(source: str, cols: list[str], keys: str = "rec_id") -> str:
    """Central differences with one-sided edges, as `<c>_dx` and `<c>_dy`."""
    out = []
    for c in cols:
        out.append(
            f"CASE WHEN x = 0 THEN lead({c}) OVER wx - {c} WHEN x = width - 1 THEN {c} - lag({c}) OVER wx "
            f"ELSE (lead({c}) OVER wx - lag({c}) OVER wx) / 2 END AS {c}_dx"
        )
        out.append(
            f"CASE WHEN y = 0 THEN lead({c}) OVER wy - {c} WHEN y = height - 1 THEN {c} - lag({c}) OVER wy "
            f"ELSE (lead({c}) OVER wy - lag({c}) OVER wy) / 2 END AS {c}_dy"
        )
    return (
        f"SELECT *, {', '.join(out)} FROM {source} WINDOW wx AS (PARTITION BY {keys}, y ORDER BY x), "
        f"wy AS (PARTITION BY {keys}, x ORDER BY y)"
    )


def phase_gradient_sql(source: str) -> str:
    inner = gradient_sql(source, ["azi_re", "azi_im", "alt_re", "alt_im"])
    parts = [
        f"({o}_re * {o}_im_{a} - {o}_im * {o}_re_{a}) / greatest({o}_re * {o}_re + {o}_im * {o}_im, 1e-12) AS d_{o}_{a}"
        for o in ("azi", "alt") for a in ("dx", "dy")
    ]
    return f"SELECT *, {', '.join(parts)} FROM ({inner})"


view("v_grad", phase_gradient_sql("v_position"), "v_position")


def _reflect(i: str, n: str) -> str:
    """Mirror an index into 0..n-1 with the edge doubled, for any overshoot."""
    m = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END)"


def pass_sql(source: str, cols: list[str], axis: str, kernel: list[tuple[int, float]], border: str, keys: str = "rec_id") -> str:
    """Gather form of one weighted pass: a join of each pixel with its kernel offsets."""
    size = "width" if axis == "x" else "height"
    other = "y" if axis == "x" else "x"
    rows = ", ".join(f"({o}, CAST({w!r} AS DOUBLE))" for o, w in kernel)
    at = f"p.{axis} + k.o"
    if border == "reflect":
        cond = f"q.{axis} = {_reflect(at, 'p.' + size)}"
    elif border == "wrap":
        cond = f"q.{axis} = (({at}) % p.{size} + p.{size}) % p.{size}"
    else:
        cond = f"q.{axis} = {at}"
    same = " AND ".join(f"p.{c} = q.{c}" for c in [*keys.replace(" ", "").split(","), other])
    ks = ", ".join(f"p.{c}" for c in keys.replace(" ", "").split(","))
    return (
        f"SELECT {ks}, p.height, p.width, p.y, p.x, "
        + ", ".join(f"sum(q.{c} * k.w) AS {c}" for c in cols)
        + f" FROM {source} p, (VALUES {rows}) k(o, w), {source} q WHERE {same} AND {cond} GROUP BY ALL"
    )


def separable_sql(source: str, cols: list[str], kernel, border: str, keys: str = "rec_id") -> str:
    one = pass_sql("s0", cols, "y", kernel, border, keys)
    two = pass_sql("s1", cols, "x", kernel, border, keys)
    return f"WITH s0 AS MATERIALIZED (SELECT * FROM {source}), s1 AS MATERIALIZED ({one}) {two}"


def gaussian_sql(source: str, cols: list[str], sigma: float, keys: str = "rec_id") -> str:
    import math

    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return separable_sql(source, cols, [(i - r, v / sum(w)) for i, v in enumerate(w)], "reflect", keys)
