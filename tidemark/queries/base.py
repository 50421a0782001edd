"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    """A two-digit double as a whole number of cents."""
    return F.round(F.col(c) * 100).cast("bigint")


def money(c: Column) -> Column:
    """Cents as text with two fraction digits."""
    size = F.abs(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(size / 100).cast("string"), F.lit("."), F.lpad(F.pmod(size, F.lit(100)).cast("string"), 2, "0"))


def sql_cents(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


def sql_money(c: str) -> str:
    return f"((CASE WHEN ({c}) < 0 THEN '-' ELSE '' END) || CAST(abs({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"
