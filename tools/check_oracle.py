"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

Usage: python tools/check_oracle.py [--sf DIR] [name ...]

Comparison: same column names, same row count, and the same multiset of
rows after sorting columns by name and rounding doubles to 6 decimals.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    import datetime as dt
    try:
        import numpy as np
        if isinstance(v, np.generic):
            v = v.item()
    except ImportError:
        pass
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        return round(v, 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return str(v) if not isinstance(v, str) else v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = sdf.collect()
    t1 = time.time()
    scols = sdf.columns
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    msg = []
    if sorted(scols) != sorted(dcols):
        msg.append(f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}")
    if len(srows) != len(drows):
        msg.append(f"rows differ: spark={len(srows)} duck={len(drows)}")
    if not msg:
        a = rows_of(scols, [tuple(r) for r in srows])
        b = rows_of(dcols, drows)
        if a != b:
            bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
            msg.append(f"values differ, e.g. {bad}")
    return (not msg), msg, len(srows), t1 - t0, t2 - t1


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from fairaudit.session import build_session
    from fairaudit.plans.registry import ORACLES, QUERIES, load_all
    load_all()
    spark = build_session(shuffle_partitions=8)
    con = duck(args.sf)
    names = args.names or sorted(QUERIES)
    ok_all = True
    for n in names:
        if n not in ORACLES:
            try:
                t0 = time.time()
                c = QUERIES[n](spark, args.sf).count()
                print(f"ROWS  {n}: {c} rows ({time.time()-t0:.1f}s)")
            except Exception as e:  # noqa: BLE001
                ok_all = False
                print(f"ERROR {n}: {type(e).__name__}: {str(e)[:400]}")
            continue
        try:
            ok, msg, nrows, ts, td = compare(spark, con, n, QUERIES[n], ORACLES[n], args.sf)
        except Exception as e:  # noqa: BLE001
            ok, msg, nrows, ts, td = False, [f"{type(e).__name__}: {str(e)[:600]}"], 0, 0, 0
        ok_all &= ok
        print(f"{'OK   ' if ok else 'FAIL '} {n}: {nrows} rows spark {ts:.1f}s duck {td:.2f}s {' '.join(msg)}")
    sys.exit(0 if ok_all else 1)


if __name__ == "__main__":
    main()
