"""Run registered queries beside their SQL and compare whole results.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, int):
        return value
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        ([_plain(r[i]) for i in order] for r in rows), key=lambda r: [str(v) for v in r])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return normal(columns, cursor.fetchall())


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def difference(left, right) -> str | None:
    """None when equal, else a short description."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    for a, b in zip(left[1], right[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"spark {a}\n  sql {b}"
    return None


def main():
    import __spark_entry__ as entry
    from siftrank import get_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    names = args[1:] or list(entry.queries())
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                              "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), []
    for name in names:
        start = time.time()
        try:
            got = spark_rows(entry.queries()[name](spark, sf_dir))
            took = time.time() - start
            start = time.time()
            problem = difference(got, sql_rows(con, oracles[name])) if name in oracles else "-"
            state = "rows" if problem == "-" else ("ok" if problem is None else "DIFF " + problem[:700])
            print(f"{name:32s} {took:6.2f}s sql {time.time() - start:5.2f}s {len(got[1]):7d} {state}", flush=True)
            if state.startswith("DIFF"):
                bad.append(name)
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"{name:32s} ERROR {type(exc).__name__} {str(exc)[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
