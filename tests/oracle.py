"""Compare registered queries with their SQL twins.

Run as a script: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime) and v.time() == dt.time():
        return v.date()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """(equal, message)."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got == want:
        return True, f"{sum(got.values())} rows"
    extra, missing = got - want, want - got
    return False, (
        f"{sum(got.values())} vs {sum(want.values())} rows; only spark {sum(extra.values())} "
        f"{sorted(extra, key=str)[:3]}; only sql {sum(missing.values())} {sorted(missing, key=str)[:3]}"
    )


def main():
    from usage_ts.plans import registry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = session(), connect(sf)
    q, o = registry.queries(), registry.oracles()
    bad = 0
    for name, fn in q.items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            if name in o:
                ok, msg = compare(spark, con, sf, fn, o[name])
            else:
                n = len(fn(spark, sf).collect())
                ok, msg = n > 0, f"{n} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t:6.2f}s {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
