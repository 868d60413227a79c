"""Compare registered queries with their SQL on another engine.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    """One comparable form for the values of both engines."""
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def in_order(rows):
    return sorted(rows, key=lambda row: [(v is not None, str(type(v)), v) if v is not None else (False,) for v in row])


def spark_rows(df):
    names = sorted(df.columns)
    return names, in_order([tuple(plain(row[n]) for n in names) for row in df.collect()])


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    names = sorted(columns)
    places = [columns.index(n) for n in names]
    return names, in_order([tuple(plain(row[i]) for i in places) for row in cursor.fetchall()])


def difference(spark_result, sql_result):
    """None when equal, else a short description."""
    (names, rows), (sql_names, expected) = spark_result, sql_result
    if names != sql_names:
        return f"columns {names} against {sql_names}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows against {len(expected)}"
    for row, other in zip(rows, expected):
        if row != other:
            return f"{dict(zip(names, row))} against {dict(zip(names, other))}"
        kinds = [(type(a), type(b)) for a, b in zip(row, other) if type(a) is not type(b)]
        if kinds:
            return f"types {kinds} in {dict(zip(names, row))}"
    return None


def main():
    from recuento.catalog import all_queries
    from recuento.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, query in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            result = spark_rows(query.run(spark, sf_dir))
            problem = difference(result, sql_rows(con, query.sql)) if query.sql else None
            rows = len(result[1])
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:700]}", "-"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={rows} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()
