"""Compare every query with its SQL on one scale directory: python -m tests.verify [sf_dir] [names...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 6) + 0.0
    return str(x)


def rows(df, cols):
    return sorted((tuple(_cell(r[c]) for c in cols) for r in df), key=repr)


def compare(spark, con, name, d):
    t = time.time()
    q = entry.queries()[name](spark, d)
    got = [r.asDict() for r in q.collect()]
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s", True
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = [dict(zip(cols, r, strict=True)) for r in cur.fetchall()]
    if sorted(cols) != sorted(q.columns):
        return f"{name}: COLUMNS {sorted(q.columns)} {sorted(cols)}", False
    cols = sorted(cols)
    a, b = rows(got, cols), rows(want, cols)
    same = a == b
    ina, inb = set(a), set(b)
    odd = "" if same else f" DIFFER {len(got)} {len(want)}\n   spark {[x for x in a if x not in inb][:3]}\n   sql   {[x for x in b if x not in ina][:3]}"
    return f"{name}: {len(got)} rows, {took:.1f} s{odd}", same


def main(args):
    d = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(entry.queries())
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    bad = 0
    for n in names:
        try:
            said, ok = compare(spark, con, n, d)
        except Exception as e:
            said, ok = f"{n}: ERROR {str(e)[:600]}", False
        bad += not ok
        print(said, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
