"""Run registered queries in Spark and their oracle SQL in DuckDB and
compare row count, column names and order-insensitive values.

Usage: python tests/oracle_compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pricewise.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, repr(round(v, 9)))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat())
    return (4, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows), "sec": round(t1 - t0, 2)}
    res["cols_ok"] = sorted(s_cols) == sorted(d_cols)
    if not res["cols_ok"]:
        res["cols"] = (s_cols, d_cols)
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    res["values_ok"] = res["cols_ok"] and a == b
    if not res["values_ok"] and res["cols_ok"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["diff"] = diff
    return res


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    filters = sys.argv[2:]
    from pricewise.plans import registry
    from pricewise.session import build_session
    registry.load_all()
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if filters and not any(f in name for f in filters):
            continue
        sql = registry.ORACLE.get(name)
        if sql is None:
            t0 = time.time()
            try:
                n = fn(spark, sf_dir).count()
            except Exception as e:  # report and continue
                bad += 1
                print(f"ERROR {name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
                continue
            print(f"ROWS-ONLY {name}: {n} rows {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            r = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as e:  # report and continue
            bad += 1
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        ok = r["values_ok"]
        bad += 0 if ok else 1
        print(("OK   " if ok else "FAIL ") + str(r)[:600], flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
