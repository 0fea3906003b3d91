"""Compare queries with their SQL in DuckDB: python -m tests.compare SF [NAME...]."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    return x


def run(spark, d, name, query, sql):
    t = time.time()
    df = query(spark, d)
    got = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return len(got), None, took, ""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    rows = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return len(got), False, took, f"columns {sorted(df.columns)} {sorted(cols)}"
    at = [cols.index(c) for c in sorted(cols)]
    want = Counter(tuple(norm(r[i]) for i in at) for r in rows)
    have = Counter(got)
    if want == have:
        return len(got), True, took, ""
    return len(got), False, took, f"only Spark {list((have - want).items())[:4]}; only SQL {list((want - have).items())[:4]}; {len(got)} {len(rows)}"


def session(cores=8):
    return (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


if __name__ == "__main__":
    import __spark_entry__ as e

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or q:
        try:
            rows, ok, took, why = run(spark, f"/root/testdata/sf{sys.argv[1]}", n, q[n], o.get(n))
        except Exception as x:
            rows, ok, took, why = -1, False, 0, f"{type(x).__name__} {str(x)[:1500]}"
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], n, rows, f"{took:.1f}s", why, flush=True)
