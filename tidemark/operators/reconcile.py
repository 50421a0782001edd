"""Intents against what is read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("OUTCOME_UNKNOWN", "MISSING", "DIFFERENT", "NOT_APPLIED", "NOT_WRITTEN", "VERIFIED")


def outcomes(intents: DataFrame, readback: DataFrame, key: Sequence[str], value: str = "value", found: str = "found") -> DataFrame:
    """Status of every intent (key, attempted, uncertain, value) after reading the target back (key, found, n).

    NOT_WRITTEN: not attempted.  OUTCOME_UNKNOWN: uncertain and not exactly one row there.
    MISSING: attempted, nothing there.  NOT_APPLIED: the old value is still there.
    DIFFERENT: another value.  VERIFIED: the intended value.
    """
    one = readback.groupBy(*key).agg(F.count(F.lit(1)).alias("n__"), F.min(found).alias("f__"))
    joined = intents.join(one, list(key), "left")
    n = F.coalesce(F.col("n__"), F.lit(0))
    status = (
        F.when(~F.col("attempted"), "NOT_WRITTEN")
        .when(F.col("uncertain") & (n != 1), "OUTCOME_UNKNOWN")
        .when(n == 0, "MISSING")
        .when(F.col("f__").eqNullSafe(F.col(value)), "VERIFIED")
        .when(F.col("f__").eqNullSafe(F.col("before")), "NOT_APPLIED")
        .otherwise("DIFFERENT")
    )
    return joined.withColumn("status", status).drop("n__", "f__")


def run_status(rows: DataFrame) -> DataFrame:
    """The run's status: the most severe that occurs; VERIFIED for none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for s in STATUSES:
        out = out.when(F.max((F.col("status") == s).cast("int")) == 1, F.lit(s))
    return rows.agg(out.otherwise(F.lit("VERIFIED")).alias("run_status"), F.count(F.lit(1)).alias("n_rows"))
