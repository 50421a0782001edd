"""Fuzzy candidates, merge groups and survivors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.relate import components
from tidemark.plans.contracts import ResolutionRule


def micro(numerator: Column, denominator: Column) -> Column:
    """A ratio in millionths, rounded half to even; both are best columns, since they are named several times."""
    n, d = numerator.cast("long") * F.lit(2_000_000), denominator.cast("long") * 2
    rest, half = F.pmod(n, d), denominator.cast("long")
    whole = F.call_function("div", n, d)
    return whole + F.when((rest > half) | ((rest == half) & (F.pmod(whole, F.lit(2)) == 1)), 1).otherwise(0)


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def levenshtein_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """Numerator and denominator of 1 - distance / longer length; 0 of 1 if either is blank."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(_blank(a) | _blank(b), F.lit(0)).otherwise(longest - F.levenshtein(a, b)), F.greatest(longest, F.lit(1))


def jaccard_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """Common tokens and all tokens of two texts; 0 of 1 if either is blank."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.when(_blank(a) | _blank(b), F.lit(0)).otherwise(F.size(F.array_intersect(x, y))), F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def levenshtein_score(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in millionths; 0 if either is blank."""
    return micro(*levenshtein_parts(a, b))


def jaccard_score(a: Column, b: Column) -> Column:
    """Common tokens over all tokens, in millionths."""
    return micro(*jaccard_parts(a, b))


def candidates(rows: DataFrame, rule: ResolutionRule, row: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (left_id, right_id, score in millionths) at or above the threshold, and findings on blocks.

    Findings: rows with a blank block value, and blocks above ``max_block`` rows, which are
    reported and not paired; that bound is the rule's own, and it bounds the pairs.
    """
    keyed = rows.select(F.col(row).alias("id"), F.array_join(F.transform(F.array(*[text.fuzzy_text(F.col(f"`{b}`").cast("string")) for b in rule.block]), lambda x: F.coalesce(x, F.lit(""))), "\x1f").alias("block"), *[text.fuzzy_text(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, (c, _, _) in enumerate(rule.compare)])
    blank = keyed.withColumn("bad", F.exists(F.split("block", "\x1f"), lambda x: x == ""))
    sizes = blank.filter("not bad").groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    findings = blank.filter("bad").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("FUZZY_BLOCKING_VALUE_MISSING").alias("code"), F.lit("").alias("block"), "n")
    findings = findings.unionByName(sizes.filter(F.col("n") > rule.max_block).select(F.lit("FUZZY_BLOCK_TOO_LARGE").alias("code"), "block", "n"))
    small = sizes.filter((F.col("n") > 1) & (F.col("n") <= rule.max_block)).select("block")
    some = blank.filter("not bad").drop("bad").join(small, "block")
    right = some.select("block", F.col("id").alias("right_id"), *[F.col(f"c{i}").alias(f"d{i}") for i in range(len(rule.compare))])
    pairs = some.join(right, "block").filter(F.col("id") < F.col("right_id"))
    weights = [round(w * 1000) for _, _, w in rule.compare]
    # distances, ratios and their sum are a projection each, so that generated code names none of them twice
    parts = [(levenshtein_parts if method == "levenshtein" else jaccard_parts)(F.col(f"c{i}"), F.col(f"d{i}")) for i, (_, method, _) in enumerate(rule.compare)]
    measured = pairs.select(F.col("id").alias("left_id"), "right_id", "block", *[x.alias(f"{n}{i}") for i, p in enumerate(parts) for n, x in zip(("n", "m"), p, strict=True)])
    ratios = measured.select("left_id", "right_id", "block", *[micro(F.col(f"n{i}"), F.col(f"m{i}")).alias(f"s{i}") for i in range(len(parts))])
    scored = ratios.select("left_id", "right_id", "block", sum((F.col(f"s{i}") * w for i, w in enumerate(weights)), F.lit(0).cast("long")).alias("weighted"))
    total = sum(weights)
    scored = scored.select("left_id", "right_id", "block", micro(F.col("weighted"), F.lit(total * 1_000_000)).alias("score"))
    return scored.filter(F.col("score") >= round(rule.threshold * 1_000_000)), findings


def bounded_degree(pairs: DataFrame, limit: int = 5, group: Sequence[str] = ()) -> DataFrame:
    """Greedy choice by score (ties by ids): a pair is taken while both ends have fewer than ``limit``.

    The choice is sequential only along chains of pairs that share a row, so each connected
    component of the candidate graph is one task's work, not each dataset.
    """
    edges = pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    comp = components(edges)
    keyed = pairs.join(comp.withColumnRenamed("node", "left_id"), "left_id")
    schema = pairs.schema

    def choose(pdf):
        pdf = pdf.sort_values(["score", "left_id", "right_id"], ascending=[False, True, True], kind="stable")
        degree: dict = {}
        keep = []
        for a, b in zip(pdf["left_id"], pdf["right_id"], strict=True):
            ok = degree.get(a, 0) < limit and degree.get(b, 0) < limit
            keep.append(ok)
            if ok:
                degree[a] = degree.get(a, 0) + 1
                degree[b] = degree.get(b, 0) + 1
        return pdf[keep][[f.name for f in schema]]

    return keyed.groupBy("component").applyInPandas(choose, schema)


def merge_groups(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of SAME_RECORD pairs, and KEEP_SEPARATE pairs that fall into one (conflicts)."""
    same = decisions.filter("decision = 'SAME_RECORD'").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    comp = components(same)
    apart = decisions.filter("decision = 'KEEP_SEPARATE'")
    left, right = comp.select(F.col("node").alias("left_id"), F.col("component").alias("cl")), comp.select(F.col("node").alias("right_id"), F.col("component").alias("cr"))
    return comp, apart.join(left, "left_id").join(right, "right_id").filter("cl = cr").select("left_id", "right_id", F.col("cl").alias("component"))


def survivors(rows: DataFrame, groups: DataFrame, row: str, fields: Sequence[str]) -> DataFrame:
    """Per group and field: the value if all members that have one agree, else null and a conflict; with the member it is from."""
    long = rows.join(groups.withColumnRenamed("node", row), row).select("component", row, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])).alias("i"))
    out = long.select("component", row, "i.*").groupBy("component", "field").agg(F.count_distinct("value").alias("n_values"), F.min("value").alias("v"), F.min(F.when(F.col("value").isNotNull(), F.col(row))).alias("from_row"), F.count(F.lit(1)).alias("n_members"))
    one = F.col("n_values") == 1
    return out.select("component", "field", F.when(one, F.col("v")).alias("value"), F.when(one, F.col("from_row")).alias("from_row"), (F.col("n_values") > 1).alias("conflict"), "n_members")


def effective_accounting(rows: DataFrame, groups: DataFrame, separate: DataFrame, row: str) -> DataFrame:
    """PASSED_THROUGH, KEPT_DISTINCT or CONTRIBUTED_TO_SURVIVOR of every row."""
    apart = separate.select(F.col("left_id").alias(row)).union(separate.select("right_id")).distinct().withColumn("apart__", F.lit(True))
    joined = rows.select(row).join(groups.withColumnRenamed("node", row), row, "left").join(apart, row, "left")
    status = F.when(F.col("component").isNotNull(), "CONTRIBUTED_TO_SURVIVOR").when(F.col("apart__"), "KEPT_DISTINCT").otherwise("PASSED_THROUGH")
    return joined.select(row, "component", status.alias("accounting"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int = 5) -> DataFrame:
    """The first ``k`` rows of each group; the rank filter lets every task keep only its own first k before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w).cast("long")).filter(F.col("rank_in_group") <= k)
