"""Queries whose rows must be those of their SQL to the last digit."""

import datetime

import duckdb

import __spark_entry__


def both(spark, folder, name, table):
    """Rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df = __spark_entry__.queries()[name](spark, str(folder))
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    return sorted(map(tuple, df.select(names).collect())), sorted(found.fetchall())


def test_stalled_runs_to_the_millisecond(spark, tmp_path):
    """Halves of a millisecond, and a silence of exactly an hour, a millisecond less and a microsecond less."""
    duckdb.sql("""COPY (SELECT row_number() OVER () AS event_id, user_id::bigint AS user_id, ts, 'view' AS event_type, 1.0 AS value, '{}' AS props FROM (VALUES
      (1, TIMESTAMP '2024-01-02 00:00:00.000600'), (1, TIMESTAMP '2024-01-02 00:00:00.000400'), (2, TIMESTAMP '2024-01-02 00:00:00.999500'), (3, TIMESTAMP '2024-01-05 09:00:00.001'),
      (4, TIMESTAMP '2024-01-05 09:00:00.002'), (5, TIMESTAMP '2024-01-05 09:00:00.000501'), (6, TIMESTAMP '2024-01-05 10:00:00.001'), (7, TIMESTAMP '2024-01-15 10:00:00.0015'), (1, TIMESTAMP '2024-01-24 10:00:00.7777')) t(user_id, ts)) TO '""" + f"{tmp_path}/events.parquet' (FORMAT parquet)")
    mine, theirs = both(spark, tmp_path, "r2_stalled_runs", "events")
    assert mine == theirs and len(mine) > 5


def test_equal_prices_of_two_lines_both_count(spark, tmp_path):
    orders = [(4 * i, 7, "O", 100.25, datetime.datetime(1999, 1, 1)) for i in range(1, 4)]
    rows = ", ".join(f"({k}, {c}, '{s}', {p}, TIMESTAMP '{d}')" for k, c, s, p, d in orders)
    duckdb.sql(f"COPY (SELECT o_orderkey::bigint AS o_orderkey, o_custkey::bigint AS o_custkey, o_orderstatus, o_totalprice::double AS o_totalprice, o_orderdate FROM (VALUES {rows}) t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    mine, theirs = both(spark, tmp_path, "b12_numeric_candidates", "orders")
    assert mine == theirs and len(mine) == 3
