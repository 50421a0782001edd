"""Frozen tables: Parquet with tagged cells and row numbers, written once and verified when read."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of source cells.
KINDS = {"null": 0, "string": 1, "boolean": 2, "integer": 3, "decimal": 4, "float": 5, "date": 6, "datetime": 7, "time": 8, "duration": 9}


class SnapshotBroken(ValueError):
    """A snapshot that isn't what was frozen."""


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``, else one in the warehouse; with a local master that one goes when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        atexit.register(shutil.rmtree, found.removeprefix("file:"), True)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def work_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage that outlives executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kind_of(field: T.StructField) -> int:
    t = field.dataType
    names = {T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer", T.DecimalType: "decimal", T.FloatType: "float", T.DoubleType: "float", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime"}
    return KINDS[names.get(type(t), "string")]


def tagged(df: DataFrame, row: str = "src_row") -> DataFrame:
    """Every column as a struct of its text and the kind of the cell."""
    cells = [F.struct(F.col(f"`{f.name}`").cast("string").alias("v"), F.when(F.col(f"`{f.name}`").isNull(), F.lit(KINDS["null"])).otherwise(F.lit(kind_of(f))).cast("tinyint").alias("k")).alias(f.name) for f in df.schema if f.name != row]
    return df.select(F.col(row).cast("long").alias(row), *cells)


def freeze(df: DataFrame, path: str, row: str = "src_row") -> dict:
    """Write a snapshot (zstd, sorted inside files by row) and return its facts: rows, row extremes and hash."""
    out = tagged(df, row)
    out.repartitionByRange(row).sortWithinPartitions(row).write.option("compression", "zstd").parquet(path)
    return facts(df.sparkSession.read.parquet(path), row) | {"schema": out.schema.json()}


def facts(df: DataFrame, row: str = "src_row") -> dict:
    cells = [c for c in df.columns if c != row]
    h = F.xxhash64(F.col(row), *[F.col(f"`{c}`.v") for c in cells], *[F.col(f"`{c}`.k") for c in cells])
    r = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(row).alias("n_distinct"), F.min(row).alias("first"), F.max(row).alias("last"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))
    return r.first().asDict()


def open_snapshot(spark: SparkSession, path: str, expected: dict, row: str = "src_row") -> DataFrame:
    """The snapshot, if schema, row count, distinct rows and hash are as frozen; else an error."""
    df = spark.read.schema(T.StructType.fromJson(json.loads(expected["schema"]))).parquet(path)
    found = facts(df, row)
    for k in ("n_rows", "n_distinct", "first", "last", "hash"):
        if found[k] != expected[k]:
            raise SnapshotBroken(f"{k}: {found[k]}, not {expected[k]}")
    if found["n_distinct"] != found["n_rows"]:
        raise SnapshotBroken("row numbers repeat")
    return df


def untagged(df: DataFrame, row: str = "src_row") -> DataFrame:
    """Cell texts only."""
    return df.select(row, *[F.col(f"`{c}`.v").alias(c) for c in df.columns if c != row])


def rows_between(df: DataFrame, first: int, end: int, row: str = "src_row") -> DataFrame:
    """Rows from ``first`` up to ``end``; the filter reaches the Parquet row groups."""
    return df.filter((F.col(row) >= first) & (F.col(row) < end))


def _schema_hash(df: DataFrame) -> str:
    return hashlib.sha256(json.dumps([(f.name, f.dataType.simpleString()) for f in df.schema]).encode()).hexdigest()


def write_prepared(df: DataFrame, path: str, binding: str = "", row: str = "src_row") -> dict:
    """Write a prepared table, one writer per partition and no shuffle; returns its facts: rows, schema hash and what it is bound to."""
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    r = stored.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(row).alias("d")).first()
    return {"n_rows": r["n"], "n_distinct": r["d"], "schema_hash": _schema_hash(df), "schema": df.schema.json(), "binding": binding}


def open_prepared(spark: SparkSession, path: str, expected: dict, binding: str = "", columns: Sequence[str] | None = None, row: str = "src_row") -> DataFrame:
    """The prepared table's ``columns``, if its binding, physical schema and rows are as written; else an error."""
    if expected["binding"] != binding:
        raise SnapshotBroken(f"bound to {expected['binding']}, not {binding}")
    if _schema_hash(spark.read.parquet(path)) != expected["schema_hash"]:
        raise SnapshotBroken("the files have another schema")
    df = spark.read.schema(T.StructType.fromJson(json.loads(expected["schema"]))).parquet(path)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(row).alias("d")).first()
    if (r["n"], r["d"]) != (expected["n_rows"], expected["n_distinct"]):
        raise SnapshotBroken(f"{r['n']} rows, not {expected['n_rows']}")
    return df.select(row, *[c for c in columns if c != row]) if columns is not None else df


def ordered_batches(df: DataFrame, size: int = 5000, row: str = "src_row") -> Iterator[list]:
    """Rows in order, at most ``size`` at a time, for an export by the driver, which holds one partition at a time."""
    batch: list = []
    for r in df.orderBy(row).toLocalIterator(prefetchPartitions=False):
        batch.append(r)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def write_values(df: DataFrame, path: str, ordinal: str, value: str) -> dict:
    """A derived column by itself: (ordinal, value), ordinals 0 to n - 1; anything else is refused.  Returns its facts."""
    from tidemark.operators.identity import integrity

    df.select(F.col(ordinal).cast("long").alias("ordinal"), F.col(value).alias("value")).write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    found = integrity(stored, "ordinal").first()
    if not found["contiguous"]:
        raise SnapshotBroken(f"ordinals don't count 0 to {found['n_rows'] - 1}")
    return {"n_rows": found["n_rows"], "schema_hash": _schema_hash(stored)}


def with_values(df: DataFrame, ordinal: str, path: str, expected: dict, out: str) -> DataFrame:
    """``df`` with a stored derived column put beside its rows by ordinal; the file must be as written."""
    stored = df.sparkSession.read.parquet(path)
    if _schema_hash(stored) != expected["schema_hash"] or stored.count() != expected["n_rows"]:
        raise SnapshotBroken("derived values aren't those that were written")
    return df.join(stored.select(F.col("ordinal").alias(ordinal), F.col("value").alias(out)), ordinal, "left")


def compact(spark: SparkSession, path: str, out: str, files: int, row: str = "src_row") -> None:
    """Many small fragments into a few files."""
    spark.read.parquet(path).repartitionByRange(files, row).sortWithinPartitions(row).write.option("compression", "zstd").parquet(out)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], ignore: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``base`` with those of ``changes`` put in by key: replacing, or only where the key is new.

    Of several changes of a key the last one counts: by ``order``, then by all values, so
    that the result doesn't depend on how the rows are dealt out.
    """
    values = [c for c in base.columns if c not in keys]
    last = F.max(F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(values)], F.lit(0).alias("z")))
    one = changes.groupBy(*keys).agg(last.alias("last__")).select(*keys, *[F.col(f"last__.v{i}").alias(c) for i, c in enumerate(values)])
    if ignore:
        return base.unionByName(one.join(base.select(*keys), list(keys), "left_anti").select(base.columns))
    return base.join(one.select(*keys), list(keys), "left_anti").select(base.columns).unionByName(one.select(base.columns))
