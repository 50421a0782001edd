"""A whole comparison in small: parts, assemblies and their lines."""

from __future__ import annotations

import json

import pytest

from tidemark.engine import preflight
from tidemark.operators.compare import set_change
from tidemark.plans.load import PlanError, load_plan
from tidemark.sources import sinks, xlsx

PLAN = {
    "datasets": [
        {"name": "products", "identity": ["code"], "scope": ["company"], "fields": [{"name": "code", "source": "code", "required": True}, {"name": "company", "source": "company"}, {"name": "title", "source": "title", "squeeze": True}, {"name": "unit", "source": "unit"}], "relations": [{"name": "unit", "parent": "units", "key": ["unit"], "origin": "target"}]},
        {"name": "assets", "identity": ["asset"], "fields": [{"name": "asset", "source": "asset"}, {"name": "title", "source": "title"}]},
        {"name": "lines", "identity": ["asset", "number"], "fields": [{"name": "asset", "source": "asset"}, {"name": "number", "source": "number", "kind": "integer"}, {"name": "quantity", "source": "quantity", "kind": "decimal", "places": 2}], "relations": [{"name": "asset", "parent": "assets", "key": ["asset"]}]},
    ]
}


def test_classes(spark):
    t = spark.createDataFrame
    sources = {
        "products": t([(2, "P1", "A", "New", "kg"), (3, "P2", "A", "Two  words", "kg"), (4, "P3", "A", "Same", "kg"), (5, "P4", "A", "Twice", "kg"), (6, "P5", "A", "No unit", "lb"), (7, "P3", "B", "Elsewhere", "kg")], "src_row long, code string, company string, title string, unit string"),
        "assets": t([(2, "A1", "One"), (3, "A2", "Two")], "src_row long, asset string, title string"),
        "lines": t([(2, "A1", "1", "2.505"), (3, "A1", "2", "1"), (4, "A9", "1", "1")], "src_row long, asset string, number string, quantity string"),
    }
    targets = {
        "products": t([("P2", "A", "Two word", "kg"), ("P3", "A", "Same", "kg"), ("P4", "A", "Twice", "kg"), ("P4", "A", "Twice", "kg")], "code string, company string, title string, unit string"),
        "units": t([("kg",)], "unit string"),
        "assets": t([("A1", "One")], "asset string, title string"),
        "lines": spark.sql("SELECT 'A1' AS asset, 1BD AS number, 9.99BD AS quantity"),
    }
    out = preflight(load_plan(json.dumps(PLAN)), sources, targets)
    classes = {n: {r.src_row: r.classification for r in d.collect()} for n, d in out.decisions.items()}
    assert classes["products"] == {2: "CREATE", 3: "UPDATE", 4: "UNCHANGED", 5: "AMBIGUOUS", 6: "BLOCKED", 7: "CREATE"}
    assert classes["assets"] == {2: "UNCHANGED", 3: "CREATE"}
    assert classes["lines"] == {2: "UPDATE", 3: "CREATE", 4: "BLOCKED"}
    assert {r.classification: r.n_rows for r in out.counts().collect()} == {"CREATE": 4, "UPDATE": 2, "UNCHANGED": 2, "AMBIGUOUS": 1, "BLOCKED": 2}
    assert [(r.src_row, r.code) for r in out.issues["lines"].collect()] == [(4, "REFERENCE_NOT_FOUND")]
    assert [(r.field, r.existing, r.proposed) for r in out.differences["products"].collect()] == [("title", "Two word", "Two words")]


def test_plans_are_strict():
    for bad in ('{"datasets": [], "more": 1}', '{"datasets": [{"name": 1}]}', '{"datasets": [{"name": "d", "identity": "x", "fields": []}]}', "[]"):
        with pytest.raises(PlanError):
            load_plan(bad)


def test_set_operations(spark):
    df = spark.createDataFrame([(["b", "a"], ["a", "b", "b"]), (["a"], ["c"]), (None, ["x"])], "e array<string>, p array<string>")
    expected = {"replace": [("a,b", False), ("c", True), ("x", True)], "add": [("a,b", False), ("a,c", True), ("x", True)], "remove": [("", True), ("a", False), ("", False)]}
    for op, rows in expected.items():
        found = df.select(set_change(df.e, df.p, op).alias("c")).collect()
        assert [(",".join(r.c["final"]), r.c["changed"]) for r in found] == rows


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "out.xlsx")
    sinks.write_workbook(path, {"rows": spark.createDataFrame([(1, "a & b"), (2, None)], "i int, s string")})
    assert [tuple(r) for r in xlsx.scan_xlsx(spark, path).collect()] == [(2, "1", "a & b"), (3, "2", None)]
