"""Queries against their SQL over tables with rows that the small given ones lack."""

import duckdb

from quillstream.plans.queries import ORACLES, QUERIES

from .test_queries import rows


def compared(spark, at, name, **tables):
    """What a query gives over tables made by SQL, and what its SQL gives."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{at}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet'")
    return rows(QUERIES[name](spark, str(at)).toPandas()), rows(con.execute(ORACLES[name]).df())


def test_opo_group_without_tokens(spark, tmp_path):
    """Two rollouts of customer 1 have no token that counts, one of customer 2 neither."""
    orders = "SELECT * FROM (VALUES (1, 1), (2, 1), (3, 2), (4, 3), (5, 3)) AS t(o_orderkey, o_custkey)"
    items = """SELECT k::BIGINT AS l_orderkey, 7::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1 AS l_linenumber, 5.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice,
      0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, f AS l_returnflag, TIMESTAMP '2024-01-01' AS l_shipdate FROM (VALUES (1, 'R'), (3, 'R'), (4, 'N'), (5, 'R')) AS t(k, f)"""
    ours, theirs = compared(spark, tmp_path, "opo", orders=orders, lineitem=items)
    assert ours == theirs and {row for adv, row in ours if adv is None} == {1, 2}
