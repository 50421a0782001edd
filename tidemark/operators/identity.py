"""Canonical keys, duplicate groups and collisions, control totals and order checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text


def identity_key(columns: Sequence[Column]) -> Column:
    """Canonical JSON of the components; null if one is null or blank."""
    whole = F.to_json(F.array(*[c.cast("string") for c in columns]))
    bad = F.lit(False)
    for c in columns:
        bad = bad | text.is_blank(c.cast("string"))
    return F.when(~bad, whole)


def with_group_size(df: DataFrame, keys: Sequence[str], out: str = "group_size") -> DataFrame:
    """Each row with how many rows have its key.

    Sizes come from a pre-aggregated table joined back, so that a key with a large part
    of all rows isn't brought to one task, as a window would do.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    renamed = sizes.select(*[F.col(f"`{k}`").alias(f"{k}__k") for k in keys], out)
    test = None
    for k in keys:
        t = df[k].eqNullSafe(renamed[f"{k}__k"])
        test = t if test is None else test & t
    return df.join(renamed, test).drop(*[f"{k}__k" for k in keys])


def duplicate_identities(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose identity others have too: every member is blocked, with the group's size."""
    return with_group_size(df, keys).filter("group_size > 1").withColumn("issue", F.lit("SOURCE_IDENTITY_DUPLICATE"))


def identity_collisions(df: DataFrame, columns: Sequence[Column], row: str) -> DataFrame:
    """Rows that collide after transformation; a row with a blank component has no identity and collides with none."""
    keyed = df.select(F.col(row), identity_key(columns).alias("identity")).filter("identity is not null")
    return with_group_size(keyed, ["identity"]).filter("group_size > 1").withColumn("issue", F.lit("POST_TRANSFORM_IDENTITY_COLLISION"))


def control_total(df: DataFrame, value: Column, expected: str, tolerance: str = "0") -> DataFrame:
    """Exact sum, included and empty rows and whether the sum is within the tolerance."""
    wide = "decimal(38,6)"
    out = df.agg(F.coalesce(F.sum(value.cast("decimal(28,6)")), F.lit(0)).cast(wide).alias("actual"), F.count(value).alias("n_included"), F.count_if(value.isNull()).alias("n_empty"))
    return out.withColumn("passed", F.abs(F.col("actual") - F.lit(expected).cast(wide)) <= F.lit(tolerance).cast(wide))


def exact_scale(df: DataFrame, column: str) -> tuple[int, int, int]:
    """Rows, most integer digits and most fraction digits of decimal texts: the first pass of an overflow-safe sum."""
    plain = F.regexp_replace(F.col(f"`{column}`"), r"\A[+-]", "")
    r = df.agg(
        F.count(plain).alias("n"),
        F.max(F.char_length(F.regexp_extract(plain, r"\A0*([0-9]*)", 1))).alias("whole"),
        F.max(F.char_length(F.regexp_extract(plain, r"\.([0-9]+)\z", 1))).alias("fraction"),
    ).first()
    return r["n"], r["whole"] or 0, r["fraction"] or 0


def exact_sum(df: DataFrame, column: str) -> DataFrame:
    """Sum of decimal texts as text, if 38 digits hold it for certain; else an error."""
    n, whole, fraction = exact_scale(df, column)
    if whole + fraction + len(str(n)) > 38:
        raise OverflowError(f"{n} values of {whole}+{fraction} digits may not fit 38 digits")
    return df.agg(F.sum(F.col(f"`{column}`").cast(f"decimal({max(1, 38 - len(str(n)))},{fraction})")).cast(f"decimal(38,{fraction})").cast("string").alias("total"))


def order_faults(df: DataFrame, ordinal: str, order: Sequence[str], bucket: int = 1 << 20) -> DataFrame:
    """Neighbours whose ordinals aren't contiguous or whose order values fall.

    Each row looks back one ordinal.  Windows run inside blocks of ordinals and each block's
    last row is also sent to the next block, so no task sees all rows.
    """
    base = df.select(F.col(ordinal).cast("long").alias("o"), F.struct(*[F.col(c) for c in order]).alias("s"))
    block = F.floor(F.col("o") / bucket)
    rows = base.select("o", "s", F.explode(F.when(F.col("o") % bucket == bucket - 1, F.array(block, block + 1)).otherwise(F.array(block))).alias("b"), block.alias("own"))
    w = Window.partitionBy("b").orderBy("o")
    seen = rows.withColumns({"po": F.lag("o").over(w), "ps": F.lag("s").over(w)}).filter("b = own")
    gap = F.col("po").isNotNull() & (F.col("o") != F.col("po") + 1)
    lost = F.col("po").isNull() & (F.col("o") != 0)
    return seen.filter(gap | lost | (F.col("ps") > F.col("s"))).select(F.col("o").alias("ordinal"), (gap | lost).alias("gap"), F.coalesce(F.col("ps") > F.col("s"), F.lit(False)).alias("falls"))


def integrity(df: DataFrame, ordinal: str) -> DataFrame:
    """Rows, nulls, distinct ordinals and their extremes in one pass, and whether they count 0 to n - 1."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(ordinal).isNull()).alias("n_null"), F.count_distinct(ordinal).alias("n_distinct"), F.min(ordinal).cast("long").alias("first"), F.max(ordinal).cast("long").alias("last"))
    return out.withColumn("contiguous", (F.col("n_rows") == 0) | ((F.col("n_null") == 0) & (F.col("n_distinct") == F.col("n_rows")) & (F.col("first") == 0) & (F.col("last") == F.col("n_rows") - 1)))
