"""Run queries in Spark and their SQL in DuckDB and compare the rows: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differs(spark, con, query, sql, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} and {len(want)} rows; only Spark {list(a - b)[:3]}; only SQL {list(b - a)[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e

    from tagweave.session import get_spark

    spark, con = get_spark(8), connect(sys.argv[1])
    sqls = e.oracle_sql()
    for name in sys.argv[2:] or list(e.queries()):
        t = time.time()
        try:
            if name in sqls:
                said = differs(spark, con, e.queries()[name], sqls[name], sys.argv[1]) or "same"
            else:
                said = f"{e.queries()[name](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {str(x)[:1500]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
