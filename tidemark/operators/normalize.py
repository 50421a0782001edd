"""Change ledger of transformations: outcomes, groups, examples, rule impacts and review policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.compile import rule_overlap
from tidemark.plans.contracts import Rule

OUTCOMES = ("invalid", "fallback", "provided", "null", "changed", "unchanged")


def outcome(raw: Column, proposed: Column, error: Column, fallback: Column, provided: bool = False) -> Column:
    """What became of a raw value, by its display."""
    return (
        F.when(error.isNotNull(), "invalid")
        .when(fallback, "fallback")
        .when(F.lit(provided), "provided")
        .when(proposed.isNull(), "null")
        .when(~raw.cast("string").eqNullSafe(proposed.cast("string")), "changed")
        .otherwise("unchanged")
    )


def outcome_counts(ledger: DataFrame, key: Sequence[str]) -> DataFrame:
    return ledger.groupBy(*key).agg(*[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES])


def rule_impacts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per selection rule: evaluated, matched and selected rows, and rows where several rules hold; one pass over the rows."""
    from tidemark.plans.compile import rule_holds

    n, first = rule_overlap(rules)
    view = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("rule_no"), rule_holds(r).alias("hit"), (first == i).alias("won"), (n > 1).alias("several")) for i, r in enumerate(rules, 1)])).alias("x")).select("x.*")
    return view.groupBy("rule_no").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("hit").alias("matched"), F.count_if(F.coalesce("won", F.lit(False))).alias("selected"), F.count_if(F.col("hit") & F.col("several")).alias("overlapping"))


def normalization_groups(ledger: DataFrame, group: Sequence[str], row: str, k: int = 5) -> DataFrame:
    """Eligible and set-aside changes per group with the first ``k`` examples by row."""
    from tidemark.operators.resolve import top_per_group

    counts = ledger.groupBy(*group).agg(F.count_if("eligible").alias("n_eligible"), F.count_if(~F.col("eligible")).alias("n_set_aside"))
    first = top_per_group(ledger.filter("eligible"), group, [row], k)
    shown = first.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_in_group", "raw"))), lambda x: x["raw"]), " | ").alias("examples"))
    return counts.join(shown, list(group), "left")


def review_policy(changes: DataFrame, policy: Mapping[str, str], default: str = "DECISION_REQUIRED") -> DataFrame:
    """Each change with what its kind asks for; the table of kinds is part of the plan."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, action in policy.items():
        out = out.when(F.col("kind") == kind, F.lit(action))
    return changes.withColumn("review", out.otherwise(F.lit(default)))
