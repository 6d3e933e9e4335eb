"""Run registered queries against their SQL twins: python scripts/check_queries.py [name-prefix ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

SF = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def compare(spark, con, QUERIES, ORACLES, name, sf):
    t0 = time.time()
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(cell(r[c]) for c in cols) for r in df.collect()]
    dt = time.time() - t0
    if name not in ORACLES:
        return f"rows-only {len(rows)}", dt, True
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"COLUMNS {cols} vs {sorted(names)}", dt, False
    at = [names.index(c) for c in cols]
    want = [tuple(cell(r[i]) for i in at) for r in cur.fetchall()]

    def key(r):
        return tuple((x is None, "" if x is None else x if not isinstance(x, (list, dict)) else str(x)) for x in r)

    try:
        a, b = sorted(rows, key=key), sorted(want, key=key)
    except TypeError:
        a, b = sorted(rows, key=repr), sorted(want, key=repr)
    if a == b:
        return f"ok {len(rows)}", dt, True
    if len(a) != len(b):
        return f"COUNT spark {len(a)} sql {len(b)}; first {a[:2]} / {b[:2]}", dt, False
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"DIFF {len(bad)}/{len(a)} cols {cols}: {bad[:3]}", dt, False


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main():
    from phasemill.catalog import ORACLES, QUERIES
    from phasemill.session import local_session

    want = sys.argv[1:]
    names = [n for n in QUERIES if not want or any(n.startswith(w) for w in want)]
    spark = local_session()
    con = connect(SF)
    bad = 0
    for n in names:
        try:
            msg, dt, ok = compare(spark, con, QUERIES, ORACLES, n, SF)
        except Exception as e:  # noqa: BLE001
            msg, dt, ok = "ERROR " + str(e)[:700], 0, False
        bad += not ok
        print(f"{n:28s} {dt:6.2f}s {msg}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
