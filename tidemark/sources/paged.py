"""Remote paged reads as a Python data source: disjoint id ranges, pages inside each, filters pushed down."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Filter operators of a capture selection.
CAPTURE_OPS = ("equals", "in_set", "on_or_after", "after", "on_or_before", "before")


class CaptureError(ValueError):
    """A page that breaks the source's promises."""


def plan_capture(fields: dict[str, dict], wanted: Sequence[str], filters: Sequence[tuple[str, str, object]] = ()) -> dict:
    """Stored scalar fields and known filters only."""
    for f in wanted:
        meta = fields.get(f)
        if meta is None or not meta.get("stored", True) or meta.get("type") in ("one2many", "many2many", "binary"):
            raise CaptureError(f"field {f!r} can't be captured")
    for f, op, _ in filters:
        if f not in fields or op not in CAPTURE_OPS:
            raise CaptureError(f"filter {op!r} on {f!r}")
    return {"fields": tuple(dict.fromkeys(("id", *wanted))), "filters": tuple(filters)}


def decode_value(value, kind: str):
    """A target's False is null except in booleans; numbers and texts must be of their type."""
    if kind == "boolean":
        if not isinstance(value, bool):
            raise CaptureError(f"{value!r} is no boolean")
        return value
    if value is False or value is None:
        return None
    if kind == "integer" and (isinstance(value, bool) or not isinstance(value, int)) or kind in ("char", "text") and not isinstance(value, str):
        raise CaptureError(f"{value!r} is no {kind}")
    return value


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    """Pages by keyset (id above the last one) inside each range of ids."""

    def __init__(self, fetch, names, page, span, high):
        self.fetch, self.names, self.page, self.span, self.high = fetch, names, page, span, high

    def partitions(self):
        return [_Range(a, min(a + self.span - 1, self.high)) for a in range(1, self.high + 1, self.span)] or [_Range(1, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        last = partition.first - 1
        while last < partition.last:
            rows = self.fetch(last, partition.last, self.page)
            if not rows:
                return
            for r in rows:
                if not last < r["id"] <= partition.last:
                    raise CaptureError(f"id {r['id']} after {last} up to {partition.last}")
                last = r["id"]
                yield tuple(r.get(n) for n in self.names)
            if len(rows) < self.page:
                return


def read_paged(spark: SparkSession, fetch: Callable[[int, int, int], list[dict]], schema: str, high: int, page: int = 500, span: int = 50_000, name: str = "tidemark_paged") -> DataFrame:
    """Rows with ids 1..``high``; ``fetch(after, up_to, limit)`` gives them in id order as dictionaries."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return PagedReader(fetch, names, page, span, high)

    spark.dataSource.register(Paged)
    return spark.read.format(name).load()


def key_chunks(keys: DataFrame, columns: Sequence[str], size: int = 500) -> DataFrame:
    """Distinct whole keys numbered into chunks of at most ``size``, for reads narrowed to what is needed.

    Numbers come from hash buckets of about ``size`` / 2 keys, each split by rank, so no
    task orders all keys.
    """
    from pyspark.sql import Window

    whole = keys.select(*columns).na.drop().distinct()
    n = whole.count()
    buckets = max(1, -(-2 * n // size))
    w = Window.partitionBy("bucket").orderBy(*columns)
    out = whole.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets))).withColumn("at", F.floor((F.row_number().over(w) - 1) / size))
    return out.select(*columns, F.concat_ws("-", "bucket", "at").alias("chunk"))
