"""Compare every registered query with its DuckDB twin.

Usage: python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return repr(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def kind(t):
    t = str(t).upper()
    for a, b in (("STRING", "VARCHAR"), ("LONG", "BIGINT"), ("BIGINT", "BIGINT"), ("VARCHAR", "VARCHAR"), ("DOUBLE", "DOUBLE"), ("BOOL", "BOOLEAN"), ("INT", "INTEGER")):
        if t.startswith(a):
            return b
    return t


def compare(spark, con, sf, name, fn, sql):
    df = fn(spark, sf)
    t0 = time.time()
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)}", True
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: kind(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS differ {sorted(df.columns)} vs {sorted(cols)}", False
    bad = {c: (kind(t), kinds[c]) for c, t in df.dtypes if kind(t) != kinds[c]}
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if bad:
        return f"TYPES differ {bad}", False
    if a != b:
        sa, sb = set(a), set(b)
        miss, extra = [x for x in b if x not in sa][:2], [x for x in a if x not in sb][:2]
        return f"VALUES differ spark={len(a)} sql={len(b)}\n   only sql: {str(miss)[:900]}\n   only spark: {str(extra)[:900]}", False
    return f"ok {len(a)} rows (collect {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s)", True


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from corpuslane.session import build_session

    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    failed = []
    for n in names:
        t = time.time()
        try:
            msg, good = compare(spark, con, args.sf, n, qs[n], sqls.get(n))
        except Exception as e:  # noqa: BLE001
            msg, good = f"ERROR {type(e).__name__}: {str(e)[:1200]}", False
        if not good:
            failed.append(n)
        print(f"{'  ' if good else '!!'} {n:28s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} good; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
