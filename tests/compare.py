"""Runs registered queries in Spark and their SQL in DuckDB and compares all rows."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return f"{value.normalize():f}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1 << 53 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """None, or what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows: {[r for r in mine[1] if r not in set(theirs[1])][:2]} {[r for r in theirs[1] if r not in set(mine[1])][:2]}"
    for a, b in zip(mine[1], theirs[1], strict=True):
        if a != b:
            return f"{mine[0]}: {a} and {b}"
    return None if mine[1] else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    folder, wanted = sys.argv[1], sys.argv[2:]
    con = connect(folder)
    sqls = __spark_entry__.oracle_sql()
    for name, query in __spark_entry__.queries().items():
        if name in sqls and (not wanted or any(name.startswith(w) for w in wanted)):
            began = time.time()
            try:
                said = compare(session, con, folder, query, sqls[name])
            except Exception as error:  # noqa: BLE001
                said = f"{type(error).__name__} {str(error)[:500]}"
            print(f"{'ok  ' if said is None else 'DIFF'} {name} {time.time() - began:.1f} s {said or ''}"[:700], flush=True)
