"""SQL text for mask operators: naive offset joins and recursive reachability."""

from __future__ import annotations

from phasemill.operators.stencil import Span


def _k(keys: str, a: str) -> str:
    return ", ".join(f"{a}.{c.strip()}" for c in keys.split(","))


def _on(keys: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in keys.split(","))


def _offsets(spans: list[Span]) -> str:
    return ", ".join(f"({dy}, {dx})" for dy, lo, hi in spans for dx in range(lo, hi + 1))


def scatter(src: str, spans, select: str = "", keys: str = "rec_id") -> str:
    extra = f", {select}" if select else ""
    return (
        f"SELECT {_k(keys, 'p')}, p.height, p.width, CAST(p.y + o.dy AS INTEGER) AS y, CAST(p.x + o.dx AS INTEGER) AS x{extra} "
        f"FROM {src} p, (VALUES {_offsets(spans)}) o(dy, dx) "
        "WHERE p.y + o.dy BETWEEN 0 AND p.height - 1 AND p.x + o.dx BETWEEN 0 AND p.width - 1"
    )


def dilate(src: str, spans, keys: str = "rec_id") -> str:
    return f"(SELECT DISTINCT * FROM ({scatter(src, spans, '', keys)}))"


def erode(src: str, spans, outside_set: bool, keys: str = "rec_id") -> str:
    """Keep a pixel when no offset meets an unset pixel; outside counts as set or unset."""
    if outside_set:
        need = (
            f"(SELECT count(*) FROM (VALUES {_offsets(spans)}) o(dy, dx) "
            "WHERE t.y + o.dy BETWEEN 0 AND t.height - 1 AND t.x + o.dx BETWEEN 0 AND t.width - 1)"
        )
    else:
        need = str(sum(hi - lo + 1 for _, lo, hi in spans))
    return (
        f"(SELECT * EXCLUDE (n) FROM (SELECT *, count(*) AS n FROM ({scatter(src, spans, '', keys)}) GROUP BY ALL) t WHERE n = {need})"
    )


def grown(src: str, n: int, keys: str = "rec_id") -> str:
    cols = ", ".join(c.strip() for c in keys.split(","))
    return f"(SELECT {cols}, height + {2 * n} AS height, width + {2 * n} AS width, y + {n} AS y, x + {n} AS x FROM {src})"


def cropped(src: str, n: int, keys: str = "rec_id") -> str:
    cols = ", ".join(c.strip() for c in keys.split(","))
    return (
        f"(SELECT * FROM (SELECT {cols}, height - {2 * n} AS height, width - {2 * n} AS width, y - {n} AS y, x - {n} AS x FROM {src}) "
        "WHERE y BETWEEN 0 AND height - 1 AND x BETWEEN 0 AND width - 1)"
    )


def roots(src: str, conn: int = 4, keys: str = "rec_id", same: str = "") -> str:
    """Each pixel with the smallest scan position reachable from it."""
    cols = ", ".join(c.strip() for c in keys.split(","))
    near = "abs(q.y - r.y) + abs(q.x - r.x) = 1" if conn == 4 else "greatest(abs(q.y - r.y), abs(q.x - r.x)) = 1"
    eq = f" AND q.{same} = r.{same}" if same else ""
    sc = f", {same}" if same else ""
    qs = f", q.{same}" if same else ""
    return (
        f"(WITH RECURSIVE px AS MATERIALIZED (SELECT * FROM {src}), r AS (SELECT {cols}, height, width, y, x{sc}, CAST(y * width + x AS BIGINT) AS root FROM px "
        f"UNION SELECT {_k(keys, 'q')}, q.height, q.width, q.y, q.x{qs}, r.root FROM r JOIN px q ON {_on(keys, 'q', 'r')} AND {near}{eq} "
        f"AND r.root < q.y * q.width + q.x) SELECT {cols}, height, width, y, x{sc}, min(root) AS root FROM r GROUP BY ALL)"
    )


def labels(src: str, conn: int = 4, order: str = "row", keys: str = "rec_id") -> str:
    first = "y * width + x" if order == "row" else "x * height + y"
    cols = ", ".join(c.strip() for c in keys.split(","))
    return (
        f"(SELECT * EXCLUDE (root, f), CAST(dense_rank() OVER (PARTITION BY {cols} ORDER BY f) AS INTEGER) AS label FROM "
        f"(SELECT *, min({first}) OVER (PARTITION BY {cols}, root) AS f FROM {roots(src, conn, keys)}))"
    )


def largest(src: str, conn: int = 4, keys: str = "rec_id") -> str:
    cols = ", ".join(c.strip() for c in keys.split(","))
    return (
        f"(SELECT * EXCLUDE (root, n, best) FROM (SELECT *, first_value(root) OVER (PARTITION BY {cols} ORDER BY n DESC, root) AS best FROM "
        f"(SELECT *, count(*) OVER (PARTITION BY {cols}, root) AS n FROM {roots(src, conn, keys)})) WHERE root = best)"
    )


def frame(src: str, keys: str = "rec_id") -> str:
    cols = ", ".join(c.strip() for c in keys.split(","))
    return (
        f"(SELECT {cols}, height, width, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x FROM (SELECT DISTINCT {cols}, height, width FROM {src}) d, "
        "range(400) a(yy), range(400) b(xx) WHERE yy < height AND xx < width)"
    )


def fill(src: str, keys: str = "rec_id") -> str:
    cols = ", ".join(c.strip() for c in keys.split(","))
    back = f"(SELECT f.* FROM {frame(src, keys)} f ANTI JOIN {src} m ON {_on(keys, 'f', 'm')} AND f.y = m.y AND f.x = m.x)"
    r = roots(back, 4, keys)
    return (
        f"(SELECT {cols}, height, width, y, x FROM {src} UNION ALL SELECT {cols}, height, width, y, x FROM "
        f"(SELECT *, bool_or(y = 0 OR x = 0 OR y = height - 1 OR x = width - 1) OVER (PARTITION BY {cols}, root) AS e FROM {r}) WHERE NOT e)"
    )


def thin(src: str, keys: str = "rec_id") -> str:
    """Zhang-Suen sub-passes, one per step of the recursion, until a key has lost nothing in two of them."""
    cols = ", ".join(c.strip() for c in keys.split(","))
    ring = {"n": (-1, 0), "ne": (-1, 1), "e": (0, 1), "se": (1, 1), "s": (1, 0), "sw": (1, -1), "w": (0, -1), "nw": (-1, -1)}
    seen = ", ".join(
        f"CAST(count(*) FILTER (WHERE q.y = p.y + ({dy}) AND q.x = p.x + ({dx})) AS INTEGER) AS {c}" for c, (dy, dx) in ring.items()
    )
    names = list(ring)
    steps = " + ".join(f"(1 - {a}) * {b}" for a, b in zip(names, names[1:] + names[:1]))
    return (
        f"(WITH RECURSIVE t AS (SELECT DISTINCT {cols}, height, width, y, x, 0 AS k, 0 AS still FROM {src} "
        f"UNION ALL SELECT {cols}, height, width, y, x, k + 1, CASE WHEN lost THEN 0 ELSE still + 1 END FROM "
        f"(SELECT *, bool_or(gone) OVER (PARTITION BY {cols}) AS lost FROM "
        f"(SELECT *, {' + '.join(names)} BETWEEN 2 AND 6 AND {steps} = 1 AND "
        "(CASE WHEN k % 2 = 0 THEN n * e * s + e * s * w ELSE n * e * w + n * s * w END) = 0 AS gone FROM "
        f"(SELECT {_k(keys, 'p')}, p.height, p.width, p.y, p.x, p.k, p.still, {seen} FROM t p JOIN t q ON {_on(keys, 'p', 'q')} "
        "AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 WHERE p.still < 2 GROUP BY ALL))) WHERE NOT gone) "
        f"SELECT {cols}, height, width, y, x FROM t WHERE still = 2)"
    )
