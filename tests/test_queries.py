"""Every registered query against DuckDB on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb
import pytest

from tidemark import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime | dt.date):
        return v.isoformat()
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(catalog.oracle_sql()[name])
    expected = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert found[0] == expected[0]
    assert len(found[1]) == len(expected[1])
    different = [(a, b) for a, b in zip(found[1], expected[1], strict=True) if a != b]
    assert not different, different[:3]


def test_degree_bounded_is_the_greedy_choice(spark, sf_dir):
    q = catalog.queries()
    pairs = q["fuzzy_candidates"](spark, sf_dir).collect()
    degree, expected = {}, set()
    for p in sorted(pairs, key=lambda p: (-p.score, p.left_id, p.right_id)):
        if degree.get(p.left_id, 0) < 1 and degree.get(p.right_id, 0) < 1:
            expected.add((p.left_id, p.right_id))
            degree[p.left_id] = degree[p.right_id] = 1
    assert {(r.left_id, r.right_id) for r in q["degree_bounded_candidates"](spark, sf_dir).collect()} == expected
