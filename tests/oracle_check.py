"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query and exits non-zero on any mismatch.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return norm(v.item())
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return int(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(
        (tuple(norm(r[i]) for i in order) for r in rows),
        key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t),
    ), [cols[i] for i in order]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"{name:28s} rows-only {len(srows)} rows  spark {t1 - t0:.2f}s", True
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    a, acols = rows_of(df.columns, srows)
    b, bcols = rows_of(dcols, drows)
    ok = acols == bcols and a == b
    msg = f"{name:28s} {'OK ' if ok else 'BAD'} spark={len(a)} oracle={len(b)}  spark {t1 - t0:.2f}s"
    if not ok:
        if acols != bcols:
            msg += f"\n   cols spark={acols}\n   cols duck ={bcols}"
        else:
            diff_a = [r for r in a if r not in b][:3]
            diff_b = [r for r in b if r not in a][:3]
            msg += f"\n   spark-only {diff_a}\n   oracle-only {diff_b}"
    return msg, ok


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as E
    from retentia.context import local_session

    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        try:
            msg, ok = compare(spark, name, qs[name], sqls.get(name), sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            msg, ok = f"{name:28s} ERROR {type(exc).__name__}: {str(exc)[:400]}", False
        bad += not ok
        print(msg, flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
