"""A whole comparison: sources through a plan, against the target, to decisions.

Everything is lazy: ``preflight`` builds DataFrames and runs no job, except for
relations that need rounds.  Datasets are taken parents first; a row whose required
parent is missing, ambiguous or blocked is blocked itself.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.compare import class_counts, classified, differences, matched
from tidemark.operators.identity import identity_key
from tidemark.plans.compile import prepare, required_on_create
from tidemark.plans.contracts import DatasetSpec, Plan
from tidemark.plans.validate import topological


@dataclass(frozen=True)
class Preflight:
    """Per dataset: decisions (row, identity, matches, classification and values), issues and field differences."""

    decisions: dict[str, DataFrame]
    issues: dict[str, DataFrame]
    differences: dict[str, DataFrame]

    def counts(self) -> DataFrame:
        """Rows of each class over all datasets."""
        out = None
        for d in self.decisions.values():
            part = d.select("classification")
            out = part if out is None else out.unionByName(part)
        return class_counts(out)


def preflight(plan: Plan, sources: Mapping[str, DataFrame], targets: Mapping[str, DataFrame], null_policy: str = "distinct", row: str = "src_row") -> Preflight:
    """``sources``: text tables with a row number; ``targets``: tables with the fields' names, typed like the plan's.

    A relation's key fields are compared with the parent dataset's identity fields, in order.
    """
    specs = {d.name: d for d in plan.datasets}
    order = topological(specs, [(r.parent, d.name) for d in plan.datasets for r in d.relations if r.origin == "incoming"])
    decisions: dict[str, DataFrame] = {}
    issues: dict[str, DataFrame] = {}
    changes: dict[str, DataFrame] = {}
    for name in order:
        spec = specs[name]
        rows = _identified(prepare(sources[name], spec, [row]), spec)
        found = F.transform("issues", lambda i: i["error"])
        found = F.concat(found, F.when(F.col("identity__").isNull(), F.array(F.lit("SOURCE_IDENTITY_INVALID"))).when(F.col("size__") > 1, F.array(F.lit("SOURCE_IDENTITY_DUPLICATE"))).otherwise(F.array().cast("array<string>")))
        rows = rows.withColumn("found__", found).drop("issues")
        for r in spec.relations:
            parents = decisions[r.parent] if r.origin == "incoming" else targets[r.parent]
            rows = _related(rows, r, parents, specs[r.parent].identity if r.parent in specs else r.key, r.origin == "incoming")
        keys = [*spec.identity, *spec.scope]
        compared = [f.name for f in spec.fields if f.provider != "omit" and f.name not in keys]
        joined = matched(rows, targets[name], {k: k for k in keys}, compared or keys)
        fields = [(c, F.col(f"`{c}`"), F.col(f"match.`{c}`"), null_policy) for c in compared]
        joined = joined.withColumn("diffs__", differences(fields) if fields else F.array().cast("array<struct<field:string,existing:string,proposed:string,policy:string>>"))
        lacks = required_on_create(spec, F.col("n_matches") > 0)
        joined = joined.withColumn("found__", F.concat("found__", F.when((F.col("n_matches") == 0) & (F.size(lacks) > 0), F.array(F.lit("REQUIRED_ON_CREATE_MISSING"))).otherwise(F.array().cast("array<string>"))))
        joined = joined.withColumn("found__", F.concat("found__", F.when(F.col("n_matches") > 1, F.array(F.lit("TARGET_IDENTITY_AMBIGUOUS"))).otherwise(F.array().cast("array<string>"))))
        blocked = F.exists("found__", lambda x: x != "TARGET_IDENTITY_AMBIGUOUS")
        joined = joined.withColumn("classification", classified(blocked, F.col("n_matches"), F.size("diffs__") > 0, F.lit(False), spec.create_policy))
        values = [f.name for f in spec.fields if f.provider != "omit"]
        decisions[name] = joined.select(F.lit(name).alias("dataset"), row, F.col("identity__").alias("identity"), "n_matches", "classification", *values)
        issues[name] = joined.select(F.lit(name).alias("dataset"), row, F.explode("found__").alias("code"))
        changes[name] = joined.filter("classification = 'UPDATE'").select(F.lit(name).alias("dataset"), row, F.inline("diffs__"))
    return Preflight(decisions, issues, changes)


def _identified(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    keyed = rows.withColumn("identity__", identity_key([F.col(f"`{k}`") for k in (*spec.identity, *spec.scope)]))
    # rows without an identity are in no group: plain equality leaves them out of the counts and of the join's keys
    sizes = keyed.filter("identity__ is not null").groupBy(F.col("identity__").alias("i__")).agg(F.count(F.lit(1)).alias("size__"))
    return keyed.join(sizes, F.col("identity__") == F.col("i__"), "left").drop("i__")


def _related(rows: DataFrame, relation, parents: DataFrame, identity, incoming: bool) -> DataFrame:
    """Adds the issue of a relation; parents are reduced to one row per key first."""
    blocked = F.max((F.col("classification") == "BLOCKED").cast("int")) if incoming else F.lit(0)
    index = parents.groupBy(*[F.col(f"`{p}`").alias(f"p{i}__") for i, p in enumerate(identity)]).agg(F.count(F.lit(1)).alias("pn__"), blocked.alias("pb__"))
    test = [F.col(f"`{k}`") == F.col(f"p{i}__") for i, k in enumerate(relation.key)]
    joined = rows.join(index, test, "left")
    empty = F.lit(False)
    for k in relation.key:
        empty = empty | F.col(f"`{k}`").isNull()
    code = (
        F.when(empty & F.lit(not relation.required_at_create), F.lit(None).cast("string"))
        .when(empty | F.col("pn__").isNull(), F.lit(None).cast("string") if relation.on_missing == "null" else F.lit("REFERENCE_NOT_FOUND"))
        .when(F.col("pn__") > 1, F.lit("REFERENCE_AMBIGUOUS"))
        .when(F.col("pb__") > 0, F.lit("REFERENCE_BLOCKED_BY_DEPENDENCY"))
    )
    out = joined.withColumn("found__", F.concat("found__", F.when(code.isNull(), F.array().cast("array<string>")).otherwise(F.array(code))))
    return out.drop(*[f"p{i}__" for i in range(len(identity))], "pn__", "pb__")
