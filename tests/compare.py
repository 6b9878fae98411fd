"""Run registered queries beside their SQL and report differences.

python tests/compare.py FOLDER [name part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else f"{number:.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def sql_rows(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def difference(spark, folder: str, run, sql: str | None) -> tuple[str, int]:
    frame = run(spark, folder)
    left = normal(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return "", len(left[1])
    right = normal(*sql_rows(folder, sql))
    if left[0] != right[0]:
        return f"columns {left[0]} <> {right[0]}", len(left[1])
    if left[1] != right[1]:
        a, b = set(left[1]), set(right[1])
        return (f"rows {len(left[1])} <> {len(right[1])}; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}",
                len(left[1]))
    return "", len(left[1])


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tracelake.session import build_session

    spark = build_session("local[8]", 8, os.environ.get("COMPARE_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    folder, parts = sys.argv[1], sys.argv[2:]
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            problem, rows = difference(spark, folder, run, entry.oracle_sql().get(name))
        except Exception as failure:
            problem, rows = f"{type(failure).__name__}: {str(failure)[:600]}", -1
        bad += bool(problem)
        mark = "BAD" if problem else "ok " if name in entry.oracle_sql() else "run"
        print(f"{mark} {name} rows={rows} {time.time() - started:.1f}s {problem}", flush=True)
    print("bad:", bad)
