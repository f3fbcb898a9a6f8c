"""Run a registered query in Spark and its DuckDB twin; compare row count,
column names and an order-insensitive digest of the values.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def digest(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple], str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    normed = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    h = hashlib.sha256(repr(normed).encode()).hexdigest()
    return cols, normed, h


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, name: str, query, sql: str | None, con=None) -> dict:
    t0 = time.time()
    df = query(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t_spark = time.time() - t0
    out = {"name": name, "rows": len(srows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sc, sn, sh = digest(scols, srows)
    dc, dn, dh = digest(dcols, drows)
    out["oracle_rows"] = len(drows)
    if sc != dc:
        out["status"] = f"columns differ: spark={sc} duck={dc}"
    elif len(srows) != len(drows):
        out["status"] = "row count differs"
    elif sh != dh:
        diff = [(a, b) for a, b in zip(sn, dn) if a != b][:3]
        out["status"] = f"values differ, e.g. {diff}"
    else:
        out["status"] = "match"
    return out


def main(argv):
    from strideframe.session import build_session
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(E.queries())
    spark = build_session("local[8]", 8)
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, sf_dir, n, q[n], o.get(n), con)
        except Exception as e:  # report and go on
            r = {"name": n, "status": f"error: {type(e).__name__}: {str(e)[:600]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
