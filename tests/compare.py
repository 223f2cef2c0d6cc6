"""Run registered queries beside their DuckDB twins: python -m tests.compare [sf_dir] [name ...]."""

import glob
import math
import os
import sys
import time

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """'' when equal, else a short account of the difference."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    dn, dr = rows_of(names, cur.fetchall())
    sn, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sn != dn:
        return f"columns {sn} / {dn}"
    if sr == dr:
        return ""
    only_s, only_d = sorted(set(sr) - set(dr))[:3], sorted(set(dr) - set(sr))[:3]
    return f"rows {len(sr)} / {len(dr)}; spark only {only_s}; duckdb only {only_d}"


if __name__ == "__main__":
    from meterline import session
    from meterline.plans import ORACLES, QUERIES

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = session.build("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in args or QUERIES:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf)
            res = compare(df, con, ORACLES[name]) if name in ORACLES else f"(rows only: {df.count()})"
        except Exception as e:  # report and go on
            res = "ERROR " + str(e)[:600]
        bad += bool(res) and not res.startswith("(")
        print(f"{'ok  ' if not res or res.startswith('(') else 'FAIL'} {name} {time.time() - t:.1f}s {res}", flush=True)
    print("failed:", bad)
