"""Run registered queries against their SQL on DuckDB: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from foretoken.session import build_session  # noqa: E402

TABLES = "documents conversations embeddings".split()


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(r[i] for i in order) for r in records), sorted(columns)


def compare(spark, con, sf_dir, name, sql):
    t0 = time.time()
    frame = entry.queries()[name](spark, sf_dir)
    got, got_columns = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    t1 = time.time()
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    want, want_columns = rows_of(columns, answer.fetchall())
    t2 = time.time()
    same = got == want and got_columns == want_columns
    types = [(f.name, f.dataType.simpleString()) for f in frame.schema.fields]
    return same, len(got), len(want), t1 - t0, t2 - t1, (got, want, got_columns, want_columns, types)


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(entry.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in names:
        sql = entry.oracle_sql().get(name)
        try:
            if sql is None:
                n = len(entry.queries()[name](spark, sf_dir).collect())
                print(f"{name}: {n} rows, no SQL", flush=True)
                continue
            same, n, m, a, b, extra = compare(spark, con, sf_dir, name, sql)
        except Exception as error:  # report and go on
            print(f"{name}: ERROR {str(error)[:600]}", flush=True)
            bad.append(name)
            continue
        print(f"{name}: {'ok' if same else 'DIFFERENT'} {n}/{m} rows {a:.2f}s/{b:.2f}s", flush=True)
        if not same:
            bad.append(name)
            got, want, gc, wc, types = extra
            print("  columns", gc, wc)
            for g, w in zip(got, want):
                if g != w:
                    print("  got ", str(g)[:400])
                    print("  want", str(w)[:400])
                    break
    print("bad:", bad)


if __name__ == "__main__":
    main()
