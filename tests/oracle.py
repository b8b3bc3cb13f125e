"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def make_spark(cores: str = "8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("spatialframe")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def kind(v):
    return "bool" if isinstance(v, bool) else type(v).__name__


def rows_of(cols, raw):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [tuple(norm(r[i]) for i in order) for r in raw]


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sec = time.time() - t
    if sql is None:
        return "rows-only", sec, f"{len(got)} rows"
    t = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    dsec = time.time() - t
    if got_cols != want_cols:
        return "FAIL", sec, f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return "FAIL", sec, f"rows {len(got)} vs {len(want)}"
    key = lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (int, float)) or isinstance(x, bool)
                          else (True, "num", x) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return "FAIL", sec, f"{len(bad)}/{len(got)} differ; {got_cols}; first {bad[0]}"
    kinds = lambda rows: [sorted({kind(r[i]) for r in rows if r[i] is not None}) for i in range(len(got_cols))]
    if kinds(got) != kinds(want):
        return "TYPE", sec, f"{got_cols} {kinds(got)} vs {kinds(want)}"
    if not got:
        return "EMPTY", sec, "no rows"
    return "ok", sec, f"{len(got)} rows, sql {dsec:.1f}s"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--all", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    names = [n for n in qs if not a.names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in a.names)]
    spark, con = make_spark(), duck(a.sf)
    n_bad = 0
    for n in names:
        try:
            status, sec, note = compare(spark, con, n, qs[n], sqls.get(n), a.sf)
        except Exception as ex:  # report and go on with the next query
            status, sec, note = "ERROR", 0.0, (type(ex).__name__ + " " + str(ex))[:1500]
        n_bad += status not in ("ok", "rows-only")
        print(f"{status:9s} {n:28s} {sec:6.2f}s  {note}", flush=True)
    print(f"{len(names)} queries, {n_bad} not ok")


if __name__ == "__main__":
    main()
