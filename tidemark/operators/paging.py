"""Pages of stored results, search and overlays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, equals: Mapping[str, object]) -> DataFrame:
    for c, v in equals.items():
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    return df


def offset_page(df: DataFrame, order: Sequence[str], page: int, size: int) -> DataFrame:
    """Page number ``page`` (from 1, clamped to what there is) in a total order."""
    last = max(1, -(-df.count() // size))
    at = min(max(page, 1), last)
    return df.orderBy(*order).offset((at - 1) * size).limit(size)


def keyset_page(df: DataFrame, ordinal: str, after: int | None = None, before: int | None = None, size: int = 50) -> DataFrame:
    """The next rows after an ordinal, or the ones right before it; the filter is pushed to the scan."""
    if before is not None:
        return df.filter(F.col(ordinal) < before).orderBy(F.desc(ordinal)).limit(size)
    return (df.filter(F.col(ordinal) > after) if after is not None else df).orderBy(ordinal).limit(size)


def search(columns: Sequence[str], query: str) -> Column:
    """Any column holds the query, in any case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).contains(query.lower())
    return out


def overlay(base: DataFrame, exceptions: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Base values, replaced where a sparse exception has one."""
    sparse = exceptions.select(*key, *[F.col(c).alias(f"{c}__x") for c in columns])
    out = base.join(sparse, list(key), "left")
    return out.withColumns({c: F.coalesce(f"{c}__x", c) for c in columns}).drop(*[f"{c}__x" for c in columns])
