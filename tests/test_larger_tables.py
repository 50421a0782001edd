"""Registered queries on tables larger than their limits for one file, and with keys beyond those of the test tables."""

from __future__ import annotations

import duckdb

from tidemark import catalog


def against_sql(spark, folder, name, *tables):
    """The query's rows and its SQL's, both sorted, with the columns in one order."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, folder)
    sql = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in df.collect()), sorted(sql)


def test_csv_round_trip_of_more_rows_than_a_file_may_have(spark, tmp_path):
    rows = spark.range(500_001).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "'BUILDING' AS c_mktsegment")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found, expected = against_sql(spark, str(tmp_path), "csv_round_trip", "customer")
    assert len(expected) == 500_001
    assert found == expected


def test_resolution_grouping_with_part_keys_above_a_million(spark, tmp_path):
    parts = [(k,) for k in (*range(1, 40), *range(1_000_001, 1_000_040))]
    lines = [(k, n) for (k,) in parts for n in range(1, 8)] + [(999, 1), (None, 2), (None, 3)]
    spark.createDataFrame(parts, "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found, expected = against_sql(spark, str(tmp_path), "resolution_grouping", "part", "lineitem")
    assert found == expected
