"""Offline target snapshots: a JSON document of metadata and records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FingerprintMismatch(ValueError):
    """Metadata and records come from different captures."""


def open_document(spark: SparkSession, path: str) -> dict:
    """The snapshot's head (fingerprints and field metadata), without its records."""
    text = spark.read.text(path, wholetext=True)
    head = text.select(F.get_json_object("value", "$.metadata").alias("m"), F.get_json_object("value", "$.records.fingerprint").alias("f")).first()
    meta = json.loads(head["m"])
    if json.loads(head["f"]) != meta["fingerprint"]:
        raise FingerprintMismatch("metadata and records have different fingerprints")
    return meta


def records(spark: SparkSession, path: str, model: str, fields: dict[str, str], limit: int | None = None) -> DataFrame:
    """(id, fields...) of one model.  ``fields``: name -> kind (text, boolean, many2one or many2many).

    Values are taken as JSON texts first, since an empty reference is ``false``.
    many2one gives the id, many2many an array of ids.
    """
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json(F.get_json_object("value", f"$.records.models['{model}'].records"), "array<struct<id:bigint,values:map<string,string>>>")).alias("r"))
    out = [F.col("r.id").alias("id")]
    for name, kind in fields.items():
        raw = F.try_element_at(F.col("r.values"), F.lit(name))
        none = raw.isNull() | (raw == "false")
        if kind == "many2one":
            value = F.when(~none, F.coalesce(F.get_json_object(raw, "$[0]"), raw).try_cast("bigint"))
        elif kind == "many2many":
            value = F.when(~none, F.from_json(raw, "array<bigint>"))
        elif kind == "boolean":
            value = raw.try_cast("boolean")
        else:
            value = F.when(~none, raw)
        out.append(value.alias(name))
    df = rows.select(*out).orderBy("id")
    return df.limit(limit) if limit is not None else df
