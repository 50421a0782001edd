"""Quality rules, dispositions, metrics and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import checks
from tidemark.plans.contracts import QualityRule

#: Policy -> severity; the gravest decides a row.
SEVERITY = {"warning": 0, "exclude": 1, "quarantine": 2, "block": 3}
DISPOSITION = {1: "EXCLUDED", 2: "QUARANTINED", 3: "BLOCKED"}
#: Part of an issue's code -> family.
FAMILIES = [("IDENTITY", "identity"), ("REFERENCE", "relationship"), ("RELATIONSHIP", "relationship"), ("REQUIRED", "completeness"), ("TYPE", "validity"), ("PATTERN", "validity"), ("LENGTH", "validity"), ("BUSINESS", "business"), ("ADVANCED", "business"), ("METRIC", "statistics"), ("OUTLIER", "statistics")]


def absent(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def family(code: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, name in FAMILIES:
        out = out.when(code.contains(part), F.lit(name))
    return out.otherwise(F.lit("other"))


def fails(rule: QualityRule) -> Column:
    """Whether a row breaks a row rule."""
    c = [F.col(f"`{x}`") for x in rule.columns]
    if rule.kind == "required_if":  # the second is required where the first has a value (or the given one)
        when = ~absent(c[0]) if rule.option("equals") is None else c[0].cast("string").eqNullSafe(F.lit(rule.option("equals")))
        return when & absent(c[1])
    if rule.kind == "exactly_one_of":
        return sum(((~absent(x)).cast("int") for x in c), F.lit(0)) != 1
    if rule.kind == "ordered":
        return ~absent(c[0]) & ~absent(c[1]) & ~(c[0] <= c[1])
    if rule.kind == "equal":
        return ~F.nullif(c[0].cast("string"), F.lit("")).eqNullSafe(F.nullif(c[1].cast("string"), F.lit("")))
    if rule.kind == "unequal":
        return ~absent(c[0]) & F.nullif(c[0].cast("string"), F.lit("")).eqNullSafe(F.nullif(c[1].cast("string"), F.lit("")))
    test = {
        "luhn": lambda: checks.luhn(c[0]),
        "iban": lambda: checks.iban(c[0]),
        "postal": lambda: checks.postal(c[0], rule.option("jurisdiction")),
        "date_window": lambda: checks.date_window(c[0], rule.option("first"), rule.option("last")),
    }[rule.kind]()
    return ~test


def row_issues(df: DataFrame, key: Sequence[str], rules: Sequence[QualityRule]) -> DataFrame:
    """Long table (key, code, policy) of broken row rules: one pass, no shuffle."""
    items = [F.when(F.coalesce(fails(r), F.lit(False)), F.struct(F.lit(r.code).alias("code"), F.lit(r.policy).alias("policy"))) for r in rules]
    return df.select(*key, F.explode(F.array_compact(F.array(*items))).alias("i")).select(*key, "i.code", "i.policy")


def dispositions(df: DataFrame, key: Sequence[str], rules: Sequence[QualityRule], base: Column | None = None) -> DataFrame:
    """Each row's effective disposition, the number of its issues and their codes; computed in the row, without a shuffle."""
    items = [F.when(F.coalesce(fails(r), F.lit(False)), F.struct(F.lit(SEVERITY[r.policy]).alias("s"), F.lit(r.code).alias("code"))) for r in rules]
    found = df.select(*key, (base if base is not None else F.lit("ELIGIBLE")).alias("base"), F.array_compact(F.array(*items)).alias("found"))
    worst = F.array_max(F.transform("found", lambda x: x["s"]))
    named = F.when(F.col("base") == "BLOCKED", "BLOCKED")
    for s in (3, 2, 1):
        named = named.when(worst == s, DISPOSITION[s])
    return found.select(*key, named.otherwise(F.col("base")).alias("disposition"), F.size("found").cast("long").alias("n_issues"), F.array_join(F.array_sort(F.transform("found", lambda x: x["code"])), ",").alias("codes"))


def quarantine_entries(rows: DataFrame, issues: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per quarantined row and quarantine issue."""
    return issues.filter("policy = 'quarantine'").join(rows.filter("disposition = 'QUARANTINED'").select(*key), list(key), "left_semi")


def metrics(df: DataFrame, column: str) -> DataFrame:
    """Count, distinct, null rate, duplicate rate, extremes and sum of a column; rates of no rows are 0."""
    c = F.col(f"`{column}`")
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(c).alias("n_distinct"),
        (F.count_if(c.isNull()) / n).alias("null_rate"),
        ((F.count(c) - F.count_distinct(c)) / n).alias("duplicate_rate"),
        F.min(c).alias("minimum"),
        F.max(c).alias("maximum"),
        F.sum(c).alias("total"),
    )


def metric_boundary(measured: DataFrame, metric: str, low: float | None, high: float | None) -> DataFrame:
    """The metric, and an issue if it is out of bounds."""
    c = F.col(metric)
    bad = F.lit(False)
    bad = bad | (c < low) if low is not None else bad
    bad = bad | (c > high) if high is not None else bad
    return measured.select(F.lit(metric).alias("metric"), c.cast("double").alias("value"), F.when(F.coalesce(bad, F.lit(False)), F.lit("METRIC_BOUNDARY_FAILED")).alias("issue"))


def metric_boundaries(measured: DataFrame, bounds: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    """``metric_boundary`` of several metrics, from one pass over what was measured."""
    items = []
    for metric, low, high in bounds:
        c, bad = F.col(metric), F.lit(False)
        bad = bad | (c < low) if low is not None else bad
        bad = bad | (c > high) if high is not None else bad
        items.append(F.struct(F.lit(metric).alias("metric"), c.cast("double").alias("value"), F.when(F.coalesce(bad, F.lit(False)), F.lit("METRIC_BOUNDARY_FAILED")).alias("issue")))
    return measured.select(F.inline(F.array(*items)))


def different_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one result that the other hasn't as often, with how often more (``only_a``, ``only_b``); none if both are the same."""
    both = a.withColumn("a__", F.lit(1)).unionByName(b.withColumn("a__", F.lit(-1))).groupBy(*a.columns).agg(F.sum("a__").alias("d__")).filter("d__ <> 0")
    return both.select(*a.columns, F.greatest("d__", F.lit(0)).cast("long").alias("only_a"), F.greatest(-F.col("d__"), F.lit(0)).cast("long").alias("only_b"))


def iqr_outliers(df: DataFrame, column: str, factor: float = 1.5, keep: Sequence[str] = (), group: Sequence[str] = ()) -> DataFrame:
    """Rows outside the quartiles by more than ``factor`` interquartile ranges; fewer than four values have none.

    Quartiles are exact (linear interpolation): ``percentile`` aggregates value counts, which
    merge before the shuffle.  The bounds, one row per group, join back.
    """
    c = F.col(f"`{column}`").cast("double")
    some = df.filter(F.col(f"`{column}`").isNotNull())
    bounds = some.groupBy(*group).agg(F.count(F.lit(1)).alias("n__"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias("q__")).filter("n__ >= 4")
    low, high = F.col("q__")[0], F.col("q__")[1]
    bounds = bounds.select(*group, (low - factor * (high - low)).alias("low"), (high + factor * (high - low)).alias("high"))
    # without groups there is one row of bounds; groups may be many, so their join is left to the planner
    joined = some.join(bounds, list(group)) if group else some.join(F.broadcast(bounds))
    return joined.filter((c < F.col("low")) | (c > F.col("high"))).select(*keep, *group, F.col(f"`{column}`"), "low", "high")


def set_issues(rows: DataFrame, key: Sequence[str], exceptions: DataFrame, default: Column) -> DataFrame:
    """Defaults for all rows, overlaid by sparse exceptions (key, status)."""
    sparse = exceptions.select(*key, F.col("status").alias("own__"))
    return rows.join(sparse, list(key), "left").withColumn("status", F.coalesce("own__", default)).drop("own__")


def source_accounting(physical: DataFrame, lineage: DataFrame, row: str = "src_row", out_row: str = "out_row") -> DataFrame:
    """Every physical row: whether a canonical row stands for it, and how many do."""
    counts = lineage.groupBy(row).agg(F.count_distinct(out_row).alias("n__"))
    joined = physical.join(counts, row, "left")
    n = F.coalesce("n__", F.lit(0)).cast("long")
    return joined.withColumns({"n_canonical": n, "accounting": F.when(n > 0, "REPRESENTED").otherwise("UNREPRESENTED")}).drop("n__")
