"""JSON texts into typed columns, and lookups of choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_json(df: DataFrame, column: str, schema: str, many: bool = False) -> DataFrame:
    """The other columns and the JSON's fields; malformed JSON stops the run.  ``many``: the text is an array of records."""
    kind = f"array<struct<{schema}>>" if many else f"struct<{schema}>"
    parsed = F.from_json(F.col(f"`{column}`"), kind, {"mode": "FAILFAST"})
    rest = [c for c in df.columns if c != column]
    view = df.select(*rest, (F.explode(parsed) if many else parsed).alias("j__"))
    return view.select(*rest, "j__.*")


def lookup_choices(df: DataFrame, label: str, value: str) -> DataFrame:
    """Labels with their only value, and labels with several, which stay apart as ambiguous."""
    pairs = df.select(F.col(f"`{label}`").alias("label"), F.col(f"`{value}`").alias("value")).distinct()
    out = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n_values"), F.min("value").alias("v"))
    return out.select("label", "n_values", F.when(F.col("n_values") == 1, F.col("v")).alias("value"), (F.col("n_values") > 1).alias("ambiguous"))
