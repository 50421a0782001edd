"""Guarded joins, unions, groups and splits.  Guards come back as violation tables, so plans stay lazy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text


class GuardViolated(ValueError):
    """Raised by ``enforce`` when a guard's table has rows."""


def enforce(violations: DataFrame, what: str) -> None:
    """Stop the run if a guard was violated; the only action of this module."""
    found = violations.limit(1).collect()
    if found:
        raise GuardViolated(f"{what}: {found[0].asDict()}")


def blank_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for k in keys:
        bad = bad | text.is_blank(F.col(f"`{k}`").cast("string"))
    return df.filter(bad)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def exact_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], columns: Sequence[str], inner: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Left rows with columns of the one right row of their key, and the guards.

    Guards: repeated right keys, blank keys on either side and, for an inner join, left
    rows without a match (it must not lose rows).  The right side is reduced to one row
    per key before the join, so a violated guard can't multiply rows.
    """
    keys = [r for _, r in on]
    one = right.groupBy(*keys).agg(*[F.min(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("m__")]) if columns else right.select(*keys).distinct()
    test = None
    for l, r in on:
        t = left[l] == one[r]
        test = t if test is None else test & t
    flagged = one.withColumn("hit__", F.lit(True))
    joined = left.join(flagged, [left[l] == flagged[r] for l, r in on], "left")
    out = joined.select(*[left[c] for c in left.columns], *[F.col(f"m__.{c}").alias(c) for c in columns], F.coalesce(F.col("hit__"), F.lit(False)).alias("matched"))
    guards = {"right keys repeated": repeated_keys(right, keys), "left keys blank": blank_keys(left, [l for l, _ in on]), "right keys blank": blank_keys(right, keys)}
    if inner:
        guards["left rows lost"] = out.filter("not matched")
        out = out.filter("matched")
    return out.drop("matched") if inner else out, guards


def reconcile_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Matched and unmatched rows of both sides, one row."""
    keys = [f"k{i}" for i in range(len(on))]
    a = left.groupBy(*[F.col(f"`{l}`").alias(k) for (l, _), k in zip(on, keys, strict=True)]).agg(F.count(F.lit(1)).alias("nl"))
    b = right.groupBy(*[F.col(f"`{r}`").alias(k) for (_, r), k in zip(on, keys, strict=True)]).agg(F.count(F.lit(1)).alias("nr"))
    both = a.join(b, keys, "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(
        total(F.when(F.col("nr").isNotNull(), F.col("nl"))).alias("left_matched"),
        total(F.when(F.col("nr").isNull(), F.col("nl"))).alias("left_unmatched"),
        total(F.when(F.col("nl").isNotNull(), F.col("nr"))).alias("right_matched"),
        total(F.when(F.col("nl").isNull(), F.col("nr"))).alias("right_unmatched"),
    )


def union_all(branches: Sequence[tuple[str, DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Rows of 2 to 10 branches with each its own column mapping (output -> input), and the branch they come from."""
    if not 2 <= len(branches) <= 10:
        raise ValueError("2 to 10 branches")
    out = None
    for number, (name, df, columns) in enumerate(branches):
        part = df.select(F.lit(number).alias("branch_no"), F.lit(name).alias("branch"), *[F.col(f"`{i}`").alias(o) for o, i in columns.items()])
        out = part if out is None else out.unionByName(part)
    return out


def group_rows(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows and exact sums per key; guards: blank keys, and values that are null."""
    named = df.select(*keys, *[c.alias(n) for n, c in sums.items()])
    out = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *[F.sum(n).alias(n) for n in sums])
    guards = {"keys blank": blank_keys(df, keys)}
    for n in sums:
        guards[f"{n} null"] = named.filter(F.col(n).isNull())
    return out, guards


def parent_split(df: DataFrame, key: Column, row: str, columns: Sequence[str], unicode: bool = False) -> DataFrame:
    """One row per key, the one with the least row number, with how many rows it stands for; rows without a key stay apart."""
    keyed = df.withColumn("key__", text.normalized_key(key, unicode))
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.col(row))
    some = keyed.filter("key__ is not null").groupBy("key__").agg(best.alias("b"), F.min(row).alias(row), F.count(F.lit(1)).alias("n_rows"))
    some = some.select("key__", F.col(row), "n_rows", *[F.col(f"b.{c}").alias(c) for c in columns])
    none = keyed.filter("key__ is null").select("key__", F.col(row), F.lit(1).cast("long").alias("n_rows"), *columns)
    return some.unionByName(none).withColumnRenamed("key__", "parent_key")


def child_projection(df: DataFrame, keys: Mapping[str, Column], row: str, columns: Sequence[str], unicode: bool = False) -> DataFrame:
    """Every row, with normalised keys."""
    return df.select(F.col(row), *[text.normalized_key(c, unicode).alias(n) for n, c in keys.items()], *columns)


def split_preview(df: DataFrame, key: Column, child: Column, unicode: bool = False) -> DataFrame:
    """Groups, rows without a key, keys changed by normalisation and repeated child keys, one row."""
    k, c = text.normalized_key(key, unicode), text.normalized_key(child, unicode)
    view = df.select(k.alias("k"), (k != key).alias("changed"), c.alias("c"))
    pairs = view.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"))
    return pairs.agg(
        F.count_distinct("k").alias("n_groups"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("n_blank"),
        F.coalesce(F.sum("changed"), F.lit(0)).cast("long").alias("n_normalised"),
        F.count_if(F.col("k").isNotNull() & F.col("c").isNotNull() & (F.col("n") > 1)).alias("n_repeated_children"),
    )


def derived_hierarchy(df: DataFrame, path: Column, row: str, separator: str = "/", unicode: bool = False) -> DataFrame:
    """Every prefix of every path once, by its case-folded key: first-seen name, depth, aliases and rows.

    More than one alias for a key asks for review.
    """
    parts = text.path_parts(path, separator, unicode)
    rows = df.select(F.col(row).alias("row__"), parts.alias("parts")).filter("parts is not null")
    each = rows.select("row__", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    prefix = F.slice("parts", F.lit(1), F.col("depth"))
    each = each.select("row__", F.col("depth").cast("long").alias("depth"), F.array_join(prefix, " / ").alias("name"), text.casefold(F.array_join(prefix, " / ")).alias("key"), text.casefold(F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), " / ")).alias("above"))
    out = each.groupBy("depth", "key", "above").agg(F.min_by("name", F.struct("row__", "name")).alias("display_name"), F.count_distinct("name").alias("n_aliases"), F.count_distinct("row__").alias("n_rows"), F.min("row__").alias("first_row"))
    return out.withColumn("parent_key", F.nullif("above", F.lit(""))).drop("above").withColumn("issue", F.when(F.col("n_aliases") > 1, F.lit("DERIVED_ALIAS_REVIEW_REQUIRED")))


def derived_reference(path: Column, separator: str = "/", unicode: bool = False) -> Column:
    """A consumer's reference to the hierarchy: struct (key, issue)."""
    parts = text.path_parts(path, separator, unicode)
    issue = F.when(text.is_blank(path), F.lit("DERIVED_REFERENCE_MISSING")).when(parts.isNull(), F.lit("DERIVED_REFERENCE_QUARANTINED"))
    return F.struct(text.casefold(F.array_join(parts, " / ")).alias("key"), issue.alias("issue"))


def lineage(df: DataFrame, out_row: str, sources: Mapping[str, str]) -> DataFrame:
    """Long lineage (out_row, dataset, src_row) of a wide row with one source row number per dataset."""
    items = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(d).alias("dataset"), F.col(c).cast("long").alias("src_row"))) for d, c in sources.items()]))
    return df.select(F.col(out_row).alias("out_row"), F.explode(items).alias("i")).select("out_row", "i.dataset", "i.src_row").distinct()


def run_rules(rules: Mapping[str, tuple[Sequence[str], object]], inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Build structural rules (name -> (inputs, function)) as their inputs appear, by name; a cycle or gap raises."""
    have, left = dict(inputs), dict(rules)
    while left:
        ready = sorted(n for n, (needs, _) in left.items() if all(x in have for x in needs))
        if not ready:
            raise ValueError(f"rules wait for each other or for missing inputs: {', '.join(sorted(left))}")
        needs, fn = left.pop(ready[0])
        have[ready[0]] = fn(*[have[x] for x in needs])
    return have


def unpivot_changes(df: DataFrame, key: Sequence[str], fields: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Long table of changed fields: (field, raw column, proposed column) per row; equal displays are dropped."""
    items = [F.when(~F.col(f"`{raw}`").cast("string").eqNullSafe(F.col(f"`{new}`").cast("string")), F.struct(F.lit(name).alias("field"), F.col(f"`{raw}`").cast("string").alias("raw"), F.col(f"`{new}`").cast("string").alias("proposed"))) for name, raw, new in fields]
    return df.select(*key, F.explode(F.array_compact(F.array(*items))).alias("i")).select(*key, "i.field", "i.raw", "i.proposed")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, if its files have fewer splits than that; a table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ordinals(df: DataFrame, order: Sequence[str], out: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Dense 0-based numbers in a total order, without one task that sees all rows.

    Rows are range-partitioned; a partition's numbers start after the rows of the
    partitions before it, whose counts (one row each) the driver adds up.  The ranges come
    from sampled quantiles, so both passes read one written table.
    """
    from tidemark.sources.snapshot import work_table

    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    stored = work_table(ranged.sortWithinPartitions(*order).withColumn("part__", F.spark_partition_id()), "ordinals")
    counts = sorted((r["part__"], r["n"]) for r in stored.groupBy("part__").agg(F.count(F.lit(1)).alias("n")).collect())
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    starts = df.sparkSession.createDataFrame(before, "part__ int, before__ long")
    number = F.row_number().over(Window.partitionBy("part__").orderBy(*order)).cast("long") - 1
    return stored.withColumn("at__", number).join(F.broadcast(starts), "part__").withColumn(out, F.col("at__") + F.col("before__")).drop("part__", "at__", "before__")
