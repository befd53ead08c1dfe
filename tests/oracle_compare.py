"""Run registered Spark queries and their DuckDB oracles side by side.

Usage:  python tests/oracle_compare.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of
rows (columns sorted by name), like the driver's check.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, repr(float(v)))
    if isinstance(v, bool):
        return (3, str(v))
    if isinstance(v, int):
        return (4, str(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return (5, v.isoformat())
    if isinstance(v, dict):
        return (6, repr(sorted((k, _norm(x)) for k, x in v.items())))
    if isinstance(v, (list, tuple)):
        return (7, repr([_norm(x) for x in v]))
    return (8, str(v))


def _rows_from_spark(df):
    cols = sorted(df.columns)
    out = []
    for r in df.select(*cols).collect():
        d = r.asDict(recursive=True)
        out.append(tuple(_norm(d[c]) for c in cols))
    return cols, out


def _rows_from_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    out = [tuple(_norm(row[i]) for i in order) for row in data]
    return cols, out


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    scols, srows = _rows_from_spark(fn(spark, sf_dir))
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    dcols, drows = _rows_from_duck(con, sql)
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows),
           "spark_s": round(t1 - t0, 2)}
    if scols != dcols:
        res.update(ok=False, detail=f"columns {scols} vs {dcols}")
        return res
    srows.sort()
    drows.sort()
    if srows != drows:
        diff = [(a, b) for a, b in zip(srows, drows) if a != b][:3]
        res.update(ok=False, detail=f"values differ, first: {diff}")
        return res
    res["ok"] = True
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    import __spark_entry__ as E
    from ratecraft.session import get_session
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for n in names or list(qs):
        try:
            r = compare(spark, con, sf_dir, n, qs[n], ors.get(n))
        except Exception as e:  # report and go on
            r = {"name": n, "ok": False, "detail": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
