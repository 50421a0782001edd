"""Propagation and reachability: long chains, cycles, repeated nodes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compare, relate
from tidemark.sources import snapshot


def test_repeated_nodes_never_multiply(spark):
    rows = [(1, None, False), (1, None, False), (2, 1, False), (3, 2, False), (4, None, True), (5, 4, False), (6, 99, False), (7, 8, False), (8, 7, False), (9, 10, False), (10, 9, True), (None, 4, False)]
    out = relate.propagate_single_parent(spark.createDataFrame(rows, "n long, p long, unsafe boolean"), "n", "p").collect()
    assert sorted((r.n or 0, r.unsafe) for r in out) == sorted([(1, False), (1, False), (2, True), (3, True), (4, True), (5, True), (6, False), (7, False), (8, False), (9, True), (10, True), (0, True)])


def test_closure_of_any_graph(spark):
    rng = random.Random(3)
    for n, m in ((12, 14), (40, 60), (30, 20)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100, 101), (101, 102), (102, 100)]
        seeds = [rng.randrange(n), 102, 500]
        seen, todo = set(seeds), list(seeds)
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out = relate.closure(spark.createDataFrame([(s,) for s in seeds], "node long"), spark.createDataFrame(edges, "parent long, child long"))
        assert sorted(r.node for r in out.collect()) == sorted(seen)


def test_a_chain_of_a_hundred_thousand(spark):
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    assert relate.closure(spark.createDataFrame([(5,)], "node long"), edges).agg(F.count("*"), F.min("node"), F.max("node")).first()[:] == (n - 4, 5, n)
    rows = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("p"), (F.col("id") == 7).alias("unsafe"))
    assert relate.propagate_single_parent(rows, "id", "p").filter("unsafe").count() == n - 7


def test_upsert_takes_the_last_change(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, t long")
    changes = spark.createDataFrame([(1, "z", 1), (1, "c", 3), (1, "d", 2), (3, "new", 1), (3, None, 2)], "k long, v string, t long").repartition(3)
    assert sorted((r.k, r.v or "", r.t) for r in snapshot.upsert(base, changes, ["k"], order=["t"]).collect()) == [(1, "c", 3), (2, "b", 0), (3, "", 2)]
    assert sorted((r.k, r.v or "") for r in snapshot.upsert(base, changes, ["k"], ignore=True, order=["t"]).collect()) == [(1, "a"), (2, "b"), (3, "")]


def test_repeated_ids_are_ambiguous(spark):
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, None)], "r long, ref long")
    parents = spark.createDataFrame([(10, "x"), (11, "y"), (11, "z")], "id long, name string")
    out = {r.r: (r.key, r.key_missing, r.key_ambiguous) for r in compare.id_to_key(rows, "ref", parents, "id", ["name"], "key").collect()}
    assert out == {1: ('["x"]', False, False), 2: (None, False, True), 3: (None, True, False), 4: (None, False, False)}


def test_composite_keys_go_through_parents(spark):
    tables = {
        "line": spark.createDataFrame([(1, 7, 100), (2, 8, 101), (3, 9, 102), (4, None, 100), (5, 7, 103)], "id long, no long, head long"),
        "head": spark.createDataFrame([(100, "h", 1), (101, "i", 9), (102, "j", 2), (103, "k", 1), (103, "l", 1)], "id long, name string, owner long"),
        "owner": spark.createDataFrame([(1, "o"), (2, "p"), (2, "q")], "id long, name string"),
    }
    parts = {"line": ["no", ("head", "head")], "head": ["name", ("owner", "owner")], "owner": ["name"]}
    out = {r.id: tuple(r)[1:] for r in compare.composite_keys(tables, parts)["line"].collect()}
    assert out == {1: ('["7",["h",["o"]]]', False, False), 2: (None, True, False), 3: (None, False, True), 4: (None, True, False), 5: (None, False, True)}
    for loop in ({"a": [("x", "b")], "b": [("y", "a")]}, {"a": [("x", "a")]}):
        with pytest.raises(ValueError, match="cycle"):
            compare.composite_keys({}, loop)
