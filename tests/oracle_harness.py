"""Run named queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and order-insensitive values (like the driver)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, "/root/repo")

from scrubspark.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name, fn, sql, sf_dir, con):
    t = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    st = time.time() - t
    if sql is None:
        return {"query": name, "status": "rows-only", "rows": len(s_rows), "spark_s": round(st, 2)}
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"query": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows), "spark_s": round(st, 2)}
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"columns differ: {sorted(s_cols)} vs {sorted(d_cols)}"
        return out
    a, b = rows_of(s_rows, s_cols), rows_of(d_rows, d_cols)
    if a == b:
        out["status"] = "match"
    else:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["status"] = "values differ"
        out["sample"] = diff or (a[:2], b[:2])
    return out


if __name__ == "__main__":
    from scrubspark.session import get_spark
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = get_spark()
    con = duck(sf)
    qs, orc = E.queries(), E.oracle_sql()
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, name, fn, orc.get(name), sf, con)
        except Exception as exc:  # report and continue
            r = {"query": name, "status": f"error: {type(exc).__name__}: {str(exc)[:300]}"}
        print(r, flush=True)
