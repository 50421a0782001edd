"""Plan validation, compiled fields, guards and iterative operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compare, identity, paging, profile, quality, relate, reshape, resolve
from tidemark.plans import validate
from tidemark.plans.compile import prepare
from tidemark.plans.contracts import Check, Condition, DatasetSpec, FieldSpec, Plan, QualityRule, RelationSpec, ResolutionRule, Rule, TextStep


def spec(**kw):
    return DatasetSpec("d", ("code",), kw.pop("fields", (FieldSpec("code", source="code"),)), **kw)


def codes(plan, columns=None, target=None):
    return {c for c, _, _ in validate.validate(plan, columns or {"d": ["code"]}, target)}


def test_valid_plan_has_no_problem(spark):
    assert codes(Plan((spec(),))) == set()


@pytest.mark.parametrize(
    ("field", "code"),
    [
        (FieldSpec("code", source="nope"), "SOURCE_FIELD_MISSING"),
        (FieldSpec("code", provider="constant"), "CONSTANT_MISSING"),
        (FieldSpec("code", source="code", kind="blob"), "KIND_UNKNOWN"),
        (FieldSpec("code", source="code", locale="xx"), "LOCALE_UNKNOWN"),
        (FieldSpec("code", source="code", kind="date", form="ymd"), "FORMAT_UNKNOWN"),
        (FieldSpec("code", source="code", rounding="odd"), "ROUNDING_UNKNOWN"),
        (FieldSpec("code", source="code", kind="integer", checks=(Check("exact_length", n=3),)), "SOURCE_VALUE_RULE_INVALID"),
        (FieldSpec("code", source="code", steps=(TextStep("pattern", "(a+)+"),)), "PATTERN_UNSAFE"),
        (FieldSpec("code", provider="formula", formula="x.y"), "SOURCE_FORMULA_INVALID"),
        (FieldSpec("code", provider="selection"), "SELECTION_RULES_BOUND"),
        (FieldSpec("code", provider="selection", rules=(Rule((Condition("code", "lt", "1"),), "x"),)), "SELECTION_OPERATOR_INCOMPATIBLE"),
        (FieldSpec("code", source="code", value_map=(("a", "b"), ("a", "c"))), "VALUE_MAP_INVALID"),
    ],
)
def test_field_problems(spark, field, code):
    assert code in codes(Plan((spec(fields=(field,)),)))


def test_dataset_problems(spark):
    assert "IDENTITY_UNMAPPED" in codes(Plan((DatasetSpec("d", ("other",), (FieldSpec("code", source="code"),)),)))
    assert "RELATION_PARENT_UNKNOWN" in codes(Plan((spec(relations=(RelationSpec("r", "zz", ("code",)),)),)))
    a = DatasetSpec("a", ("code",), (FieldSpec("code", source="code"),), relations=(RelationSpec("r", "b", ("code",)),))
    b = DatasetSpec("b", ("code",), (FieldSpec("code", source="code"),), relations=(RelationSpec("r", "a", ("code",)),))
    assert "DEPENDENCY_CYCLE" in codes(Plan((a, b)), {"a": ["code"], "b": ["code"]})
    target = {"d": {"code": {"type": "integer"}, "must": {"type": "char", "required": True}}}
    assert codes(Plan((spec(),)), target=target) == {"TARGET_TYPE_INCOMPATIBLE", "TARGET_REQUIRED_UNMAPPED"}


def test_driver_helpers():
    assert validate.topological(["c", "b", "a"], [("a", "c")]) == ["a", "b", "c"]
    assert validate.recommend_key({}, "m", [("x",), ("y",)], {"x"}) == ("x",)
    assert validate.write_collisions([("o1", "m", "f"), ("o2", "m", "f"), ("o1", "m", "g")]) == [("m", "f", ("o1", "o2"))]
    assert validate.union_requirements([("m", ["b"]), ("m", ["a"])]) == {"m": ("a", "b")}
    assert [x[2] for x in validate.code_drift({"f": ["a", "b"]}, {"f": ["b", "c"]})] == ["added c", "removed a"]


def test_error_precedence(spark):
    fields = (
        FieldSpec("v", provider="selection", rules=(Rule((Condition("n", "gt", "5", "integer"),), "x"),), required=True),
        FieldSpec("w", source="w", kind="integer", required=True),
    )
    df = spark.createDataFrame([("9", "1"), ("z", "1"), ("1", ""), ("", "q")], "n string, w string")
    found = [[i["error"] for i in r.issues] for r in prepare(df, DatasetSpec("d", ("v",), fields)).collect()]
    assert found == [[], ["SOURCE_SELECTION_RULE_SOURCE_INVALID"], ["SOURCE_SELECTION_RULE_UNRESOLVED", "SOURCE_REQUIRED_VALUE_MISSING"], ["SOURCE_SELECTION_RULE_UNRESOLVED", "SOURCE_TYPE_INVALID"]]


def test_prepare_is_one_narrow_stage(spark):
    df = spark.createDataFrame([("1", "a")], "n string, s string")
    plan = prepare(df, DatasetSpec("d", ("n",), (FieldSpec("n", source="n", kind="integer"), FieldSpec("s", source="s", case="title"))))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_join_guards(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "i int, k string")
    right = spark.createDataFrame([("a", 1), ("a", 2)], "r string, v int")
    out, guards = reshape.exact_join(left, right, [("k", "r")], ["v"])
    assert out.count() == 3
    assert {n: g.count() for n, g in guards.items()} == {"right keys repeated": 1, "left keys blank": 1, "right keys blank": 0}
    with pytest.raises(reshape.GuardViolated):
        reshape.enforce(guards["right keys repeated"], "right keys repeated")
    inner, guards = reshape.exact_join(left, right, [("k", "r")], ["v"], inner=True)
    assert guards["left rows lost"].count() == 2 and inner.count() == 1


def test_rules_run_as_inputs_appear(spark):
    a = spark.range(3)
    out = reshape.run_rules({"z": (("y",), lambda d: d.filter("id > 0")), "y": (("a",), lambda d: d.union(d))}, {"a": a})
    assert out["z"].count() == 4
    with pytest.raises(ValueError, match="wait"):
        reshape.run_rules({"p": (("q",), None), "q": (("p",), None)}, {})


def test_propagation_survives_cycles_and_long_chains(spark):
    n = 300
    chain = spark.createDataFrame([(i, i - 1 if i else None, i == 3) for i in range(n)], "n int, p int, unsafe boolean")
    found = {r.n: r.unsafe for r in relate.propagate_single_parent(chain, "n", "p").collect()}
    assert all(found[i] == (i >= 3) for i in range(n))
    ring = spark.createDataFrame([(0, 2, False), (1, 0, True), (2, 1, False), (9, 9, False)], "n int, p int, unsafe boolean")
    assert {r.n: r.unsafe for r in relate.propagate_single_parent(ring, "n", "p").collect()} == {0: True, 1: True, 2: True, 9: False}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "parent int, child int")
    assert sorted(r.node for r in relate.closure(spark.createDataFrame([(1,)], "node int"), edges).collect()) == [1, 2, 3]
    assert relate.closure(spark.createDataFrame([], "node int"), edges).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100) if i != 50], "a int, b int")
    found = {r.node: r.component for r in relate.components(edges).collect()}
    assert all(found[i] == (0 if i <= 50 else 51) for i in range(101))


def test_fuzzy_candidates_and_degree(spark):
    rows = spark.createDataFrame([(1, "x", "Anna Smith"), (2, "x", "anna smith!"), (3, "x", "Ana Smith"), (4, "", "q"), *[(i, "big", "n") for i in range(10, 15)]], "id int, b string, name string")
    rule = ResolutionRule("r", ("b",), (("name", "levenshtein", 1.0),), 0.85, max_block=4, max_degree=1)
    pairs, findings = resolve.candidates(rows, rule, "id")
    assert {(r.left_id, r.right_id, r.score) for r in pairs.collect()} == {(1, 2, 1_000_000), (1, 3, 900_000), (2, 3, 900_000)}
    assert {(r.code, r.n) for r in findings.collect()} == {("FUZZY_BLOCKING_VALUE_MISSING", 1), ("FUZZY_BLOCK_TOO_LARGE", 5)}
    assert {(r.left_id, r.right_id) for r in resolve.bounded_degree(pairs, 1).collect()} == {(1, 2)}


def test_merge_conflicts(spark):
    d = spark.createDataFrame([(1, 2, "SAME_RECORD"), (2, 3, "SAME_RECORD"), (1, 3, "KEEP_SEPARATE"), (8, 9, "KEEP_SEPARATE")], "left_id int, right_id int, decision string")
    groups, conflicts = resolve.merge_groups(d)
    assert {(r.node, r.component) for r in groups.collect()} == {(1, 1), (2, 1), (3, 1)}
    assert [(r.left_id, r.right_id) for r in conflicts.collect()] == [(1, 3)]


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, "", None)], "k int, s string, n double")
    rules = [QualityRule("A", "required_if", ("n", "s"), "block"), QualityRule("B", "exactly_one_of", ("s", "n"), "warning")]
    assert {(r.k, r.disposition, r.codes) for r in quality.dispositions(df, ["k"], rules).collect()} == {(1, "BLOCKED", "A"), (2, "ELIGIBLE", "B")}
    assert quality.iqr_outliers(df, "n").count() == 0  # fewer than four values
    assert quality.metrics(df.limit(0), "n").first()["null_rate"] == 0


def test_class_precedence(spark):
    df = spark.createDataFrame([(True, 2, True), (False, 2, True), (False, 0, True), (False, 1, True), (False, 1, False)], "b boolean, n long, d boolean")
    for policy, expected in (("create", ["BLOCKED", "AMBIGUOUS", "CREATE", "UPDATE", "UNCHANGED"]), ("block", ["BLOCKED", "AMBIGUOUS", "BLOCKED", "UPDATE", "UNCHANGED"]), ("create_only", ["BLOCKED", "AMBIGUOUS", "CREATE", "UNCHANGED", "UNCHANGED"])):
        assert [r[0] for r in df.select(compare.classified(F.col("b"), F.col("n"), F.col("d"), F.lit(False), policy)).collect()] == expected


def test_ordinals_and_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    out = reshape.ordinals(df, ["v"], partitions=7)
    assert out.filter("v <> ordinal").count() == 0 and out.count() == 1000
    assert identity.order_faults(out, "ordinal", ["v"], bucket=64).count() == 0
    assert identity.order_faults(out.filter("ordinal <> 500"), "ordinal", ["v"], bucket=64).count() == 1
    assert paging.offset_page(out, ["v"], 999, 300).count() == 100


def test_exact_sum_refuses_what_may_overflow(spark):
    df = spark.createDataFrame([("1" * 20 + ".5",), ("-0.25",)], "v string")
    assert identity.exact_sum(df, "v").first()["total"] == "1" * 20 + ".25"
    with pytest.raises(OverflowError):
        identity.exact_sum(spark.createDataFrame([("9" * 38,)], "v string"), "v")


def test_profile_kinds(spark):
    texts = {"007": "string", "7": "integer", "-1.5": "decimal", "1e5": "decimal", "2024-02-30": "string", "2024-02-29": "date", "2024-02-29T10:00:00": "datetime", "true": "boolean", "": None}
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert {r.s: r.k for r in df.select("s", profile.value_kind(F.col("s")).alias("k")).collect()} == texts
    assert profile.headers(["a", " ", "A"]) == (["a", "Column 2", "A"], ["A", "a"])
