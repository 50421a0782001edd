"""Incremental keyset capture as a stream: ids above the last one up to a frozen high-water mark.

A micro-batch is the ids between two offsets, cut into ranges of ``span`` ids that
executors read side by side, page by page; the driver learns high-water marks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from tidemark.sources.paged import PagedReader, _Range


class _Reader(DataSourceStreamReader):
    def __init__(self, fetch, high_water, names, page, span):
        self.fetch, self.high_water, self.names, self.page, self.span = fetch, high_water, names, page, span

    def initialOffset(self) -> dict:
        return {"id": 0}

    def latestOffset(self) -> dict:
        return {"id": self.high_water()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [_Range(a, min(a + self.span - 1, end["id"])) for a in range(start["id"] + 1, end["id"] + 1, self.span)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from PagedReader(self.fetch, self.names, self.page, self.span, partition.last).read(partition)

    def commit(self, end: dict) -> None:
        pass


def capture_stream(spark: SparkSession, fetch: Callable[[int, int, int], list[dict]], high_water: Callable[[], int], schema: str, page: int = 500, span: int = 50_000, name: str = "tidemark_capture") -> DataFrame:
    """A streaming DataFrame; its offset is the last id, so a restarted query goes on where its checkpoint is."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    class Capture(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def streamReader(self, schema):
            return _Reader(fetch, high_water, names, page, span)

    spark.dataSource.register(Capture)
    return spark.readStream.format(name).load()


def run_available(stream: DataFrame, path: str, checkpoint: str, batches: int = 1) -> None:
    """Append what is there to a Parquet table, ``batches`` micro-batches at least."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
    try:
        for _ in range(batches):
            query.processAllAvailable()
    finally:
        query.stop()
