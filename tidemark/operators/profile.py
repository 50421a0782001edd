"""Column profiles and value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text

EXACT_DISTINCT = 10_000


def value_kind(c: Column) -> Column:
    """boolean, integer, decimal, date, datetime or string of a text; null for blank.  Leading zeros make a string."""
    v = F.trim(c)
    return (
        F.when(c.isNull() | (v == ""), F.lit(None).cast("string"))
        .when(F.lower(v).isin("true", "false"), F.lit("boolean"))
        .when(v.rlike(r"\A[+-]?(?:0|[1-9][0-9]*)\z"), F.lit("integer"))
        .when(v.rlike(r"\A[+-]?(?:0|[1-9][0-9]*)?\.[0-9]+\z|\A[+-]?[0-9]+(?:\.[0-9]*)?[eE][+-]?[0-9]+\z"), F.lit("decimal"))
        .when(v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]") & v.try_cast("timestamp").isNotNull(), F.lit("datetime"))
        .when(v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & v.try_cast("date").isNotNull(), F.lit("date"))
        .otherwise(F.lit("string"))
    )


def candidate_type(kinds: Column) -> Column:
    """Type of a column from its set of kinds: integers among decimals are decimal, dates among datetimes datetime."""
    kinds = F.array_sort(kinds)
    same = lambda *names: kinds == F.array(*map(F.lit, sorted(names)))
    return F.when(F.size(kinds) == 0, F.lit("empty")).when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).when(same("integer", "decimal"), F.lit("decimal")).when(same("date", "datetime"), F.lit("datetime")).otherwise(F.lit("mixed"))


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column: counts, distinct, duplicates, lengths, extremes and candidate type.

    One long aggregation for all columns.  ``exact=False`` sketches the distinct counts,
    for columns with more values than fit an exact count's shuffle.
    """
    names = columns or df.columns
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column_name"), F.col(f"`{n}`").cast("string").alias("v")) for i, n in enumerate(names)]))
    long = df.select(pairs.alias("p")).select("p.*")
    long = long.withColumn("blank", F.col("v").isNull() | (F.trim("v") == "")).withColumn("kind", value_kind(F.col("v")))
    some = F.when(~F.col("blank"), F.col("v"))
    distinct = F.count_distinct(some) if exact else F.approx_count_distinct(some)
    out = long.groupBy("position", "column_name").agg(
        F.count_if("blank").alias("null_count"),
        F.count(some).alias("non_null_count"),
        distinct.alias("distinct_count"),
        F.min(F.char_length(some)).cast("long").alias("min_length"),
        F.max(F.char_length(some)).cast("long").alias("max_length"),
        F.min(some).alias("min_text"),
        F.max(some).alias("max_text"),
        candidate_type(F.collect_set("kind")).alias("candidate_type"),
    )
    return out.withColumn("duplicate_count", F.col("non_null_count") - F.col("distinct_count")).drop("position")


def headers(names: list[str]) -> tuple[list[str], list[str]]:
    """Shown names (blank ones numbered) and the names that come twice when case is folded."""
    shown = [n.strip() or f"Column {i}" for i, n in enumerate(names, 1)]
    folded = [n.casefold() for n in shown]
    return shown, sorted({n for n in shown if folded.count(n.casefold()) > 1})


def choices(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """Stripped values that aren't blank, with how many rows have each."""
    value = text.trim(F.col(f"`{column}`").cast("string"))
    return df.select(value.alias(out)).filter(F.col(out) != "").groupBy(out).agg(F.count(F.lit(1)).alias("n_rows"))


def choice_tuples(df: DataFrame, columns: list[str], strip: bool = True, blanks: bool = False) -> DataFrame:
    """Combinations of values with their rows; without ``blanks``, only whole ones."""
    view = df.select(*[(text.trim(F.col(f"`{c}`").cast("string")) if strip else F.col(f"`{c}`").cast("string")).alias(c) for c in columns])
    if not blanks:
        for c in columns:
            view = view.filter(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != ""))
    return view.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))


def uncovered(values: DataFrame, mapping: DataFrame, column: str = "value") -> DataFrame:
    """Choices without a row in the mapping."""
    return values.join(mapping.select(column).distinct(), column, "left_anti")


def preview(df: DataFrame, order: str, n: int = 20, width: int = 200) -> DataFrame:
    """The first rows, shortened for display."""
    return df.orderBy(order).limit(n).select(*[F.left(F.col(f"`{c}`").cast("string"), F.lit(width)).alias(c) for c in df.columns])


def ragged(lines: DataFrame, column: str, separator: str, width: int) -> DataFrame:
    """Rows shorter and longer than the header; all-blank lines don't count."""
    import re

    n = F.size(F.split(column, re.escape(separator)))
    some = lines.filter(F.trim(F.translate(F.col(column), separator, "")) != "")
    return some.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(n < width).alias("n_short"), F.count_if(n > width).alias("n_long"))
