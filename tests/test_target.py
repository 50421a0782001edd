"""Loads, read-back, prepared and derived tables, report files and plan checks."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import validate
from tidemark.plans.contracts import ControlTotal, DatasetSpec, FieldSpec, Plan, RelationSpec
from tidemark.sources import csvscan, sinks, snapshot, target
from tidemark.sources.paged import CaptureError


def intents(spark, n=30):
    rows = []
    for k in range(n):
        rows.append((k, "CREATE" if k % 2 else "UPDATE", k % 3, 1, "name", f"n{k}"))
        if k % 5 == 0:
            rows.append((k, "CREATE" if k % 2 else "UPDATE", k % 3, 1, "size", None))
        if k % 4 == 0:
            rows.append((k, "CREATE" if k % 2 else "UPDATE", k % 3, 2, "parent", "p"))
    return spark.createDataFrame(rows, "k long, classification string, sequence int, phase int, field string, value string")


def test_batches_have_one_field_set(spark):
    def send(classification, fields, rows, token):
        assert 0 < len(rows) <= 4 and len(token) == 64
        assert all(set(r) == {"k", *fields} for r in rows) and len({r["k"] % 2 for r in rows}) == 1
        return [r.get("name") != "n7" for r in rows]

    out = {(r.k, r.phase): r.status for r in target.two_phase_load(intents(spark), ["k"], send, 4).collect()}
    assert out == {**{(k, 1): "FAILED" if k == 7 else "WRITTEN" for k in range(30)}, **{(k, 2): "WRITTEN" for k in range(0, 30, 4)}}


def test_an_unknown_outcome_stops_the_load(spark):
    def send(classification, fields, rows, token):
        if any(r["k"] == 4 for r in rows):  # the second dataset
            raise target.UnknownOutcome
        return [True] * len(rows)

    out = {(r.k, r.phase): r.status for r in target.two_phase_load(intents(spark), ["k"], send, 1).collect()}
    assert out[4, 1] == "OUTCOME_UNKNOWN"
    assert all(s == "WRITTEN" for (k, p), s in out.items() if p == 1 and k % 3 == 0)  # the first dataset
    assert all(s == "NOT_ATTEMPTED" for (k, p), s in out.items() if p == 2 or k % 3 == 2)
    assert len(out) == 38 and target.two_phase_load(intents(spark).limit(0), ["k"], send).count() == 0


def test_read_back_asks_for_whole_keys_only(spark):
    keys = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k long, s string")

    def fetch(columns, asked):
        assert columns == ("k", "s") and len(asked) <= 20
        return [{"k": k, "s": s, "v": k * 10} for k, s in asked for _ in range(k)]

    out = target.read_back(keys, ["k", "s"], fetch, "v long").collect()
    assert sorted((r.k, r.s, r.v) for r in out) == [(1, "a", 10), (3, "c", 30), (3, "c", 30), (3, "c", 30)]
    with pytest.raises(Exception, match="wasn't asked for"):
        target.read_back(keys, ["k", "s"], lambda c, a: [{"k": 9, "s": "z", "v": 1}], "v long").collect()
    assert issubclass(CaptureError, ValueError)


def test_header_and_columns(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b"Report,2024,\n\nCode,Name,Size\n1,x,\n2,\"y\nz\"\n")
    rows = [tuple(r) for r in csvscan.scan_csv(spark, str(p), csvscan.Dialect("utf-8", ","), header="detect", columns=["Size", "Name"]).collect()]
    assert rows == [(4, "", "x"), (5, None, "y\nz")]
    assert csvscan.scan_csv(spark, str(p), csvscan.Dialect("utf-8", ","), header=3).columns == ["src_row", "Code", "Name", "Size"]
    with pytest.raises(csvscan.ScanError, match="no column"):
        csvscan.scan_csv(spark, str(p), csvscan.Dialect("utf-8", ","), header=3, columns=["Gone"])
    with pytest.raises(csvscan.ScanError, match="no header"):
        csvscan.scan_csv(spark, str(p), csvscan.Dialect("utf-8", ","), header=99)


def test_prepared_tables_are_checked(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("src_row"), (F.col("id") * 2).alias("v"), F.lit("x").alias("w"))
    path = f"file://{tmp_path}/p"
    facts = snapshot.write_prepared(df, path, "plan 1")
    out = snapshot.open_prepared(spark, path, facts, "plan 1", ["w"])
    assert out.columns == ["src_row", "w"]
    assert [len(b) for b in snapshot.ordered_batches(out, 30)] == [30, 30, 30, 10]
    assert [r.src_row for b in snapshot.ordered_batches(out, 30) for r in b] == list(range(100))
    with pytest.raises(snapshot.SnapshotBroken, match="bound"):
        snapshot.open_prepared(spark, path, facts, "plan 2")
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(snapshot.SnapshotBroken, match="rows"):
        snapshot.open_prepared(spark, path, facts, "plan 1")
    with pytest.raises(snapshot.SnapshotBroken, match="schema"):
        snapshot.open_prepared(spark, path, {**facts, "schema_hash": "0"}, "plan 1")


def test_derived_values_count_from_zero(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") * 3).alias("v"))
    facts = snapshot.write_values(df, f"file://{tmp_path}/v", "id", "v")
    assert {r.id: r.back for r in snapshot.with_values(df, "id", f"file://{tmp_path}/v", facts, "back").collect()} == {i: 3 * i for i in range(5)}
    with pytest.raises(snapshot.SnapshotBroken):
        snapshot.write_values(df.filter("id <> 2"), f"file://{tmp_path}/w", "id", "v")
    with pytest.raises(snapshot.SnapshotBroken):
        snapshot.with_values(df, "id", f"file://{tmp_path}/v", {**facts, "n_rows": 6}, "back")


def test_report_files_are_whole(spark, tmp_path):
    folder = str(tmp_path / "report")
    df = spark.createDataFrame([(1, "=1+1"), (2, None)], "k long, t string")
    for _ in range(2):  # a second report takes the first one's place
        manifest = sinks.write_results(folder, {"a": df, "b": df.limit(0)}, {"run": 7}, preview=1)
    assert sorted(os.listdir(folder)) == ["a.csv", "b.csv", "manifest.json", "results.xlsx"]
    with open(f"{folder}/manifest.json", encoding="utf-8") as f:
        assert json.load(f) == manifest
    assert manifest["results"]["a"] == {"columns": ["k", "t"], "rows": 2, "shown": 1} and manifest["about"] == {"run": 7}
    with open(f"{folder}/a.csv", encoding="utf-8") as f:
        assert f.read().splitlines() == ['"k","t"', '"1","\'=1+1"']


def test_plans_without_a_fault_have_no_problem():
    plan = Plan((
        DatasetSpec("a", ("code",), (FieldSpec("code", source="x", required=True), FieldSpec("size", source="y", kind="decimal"))),
        DatasetSpec("b", ("no",), (FieldSpec("no", source="z"), FieldSpec("a", source="x")), relations=(RelationSpec("a", "a", ("a",)),)),
    ))
    columns = {"a": ["x", "y"], "b": ["z", "x"]}
    schema = {"a": {"code": {"type": "char", "required": True}, "size": {"type": "float"}}, "b": {"no": {"type": "char"}, "a": {"type": "many2one", "relation": "a"}}}
    assert validate.validate(plan, columns, schema) == []
    bound = validate.definition_hash(columns), validate.definition_hash(schema)
    assert validate.binding_problems(bound, {"b": ["x", "z"], "a": ["y", "x"]}, schema) == []
    assert [p[0] for p in validate.binding_problems(bound, columns, {})] == ["SCHEMA_HASH_MISMATCH"]
    assert validate.control_total_problems(plan, [ControlTotal("a", "size", "1.50", "0.01")]) == []
    assert validate.metadata_requests(plan) == {"a": ("code", "size"), "b": ("a", "no")}
