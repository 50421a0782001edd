"""What the operators share: written tables, Arrow batches of texts, hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES = 512 * 1024
BATCH_ROWS_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def public_vocabulary(name: str) -> str:
    """Place of a public vocabulary file, by its name or as given; read on the executors, never copied."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- written tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse.

    With a local master the one in the warehouse goes when the driver ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidemark-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        atexit.register(shutil.rmtree, found.removeprefix("file:"), True)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_work_tables(spark: SparkSession) -> int:
    """Delete the tables and shards that this driver wrote on the way; call it when results are stored elsewhere."""
    n = len(_made)
    for path in _made:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _made.clear()
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(df: DataFrame, names, keep: list[str] | None = None) -> list[str]:
    """Columns of ``df`` (or of ``keep``) that don't clash with ``names`` in any case: those named like a result give way."""
    taken = {n.lower() for n in names}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]


def column_of(df: DataFrame, name: str) -> str | None:
    """The column that ``name`` means, in any case; None if there is none."""
    return next((c for c in df.columns if c == name), next((c for c in df.columns if c.lower() == name.lower()), None))


# ---------------------------------------------------------------- Arrow


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose tasks give their memory back when they end, in batches that long texts can't make too large."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_ROWS_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_ROWS_CONF, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over Arrow batches, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return in_arrow(df, run, schema)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text is a range of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    total, begin = np.cumsum(sizes), 0
    while begin < n:
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
        yield begin, end
        begin = end


def texts_of(batch: pa.RecordBatch, column: str, begin: int, end: int) -> list[str]:
    """Texts of a row range; null is empty."""
    return [t or "" for t in batch.column(column).slice(begin, end - begin).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a row range, concatenated, and where each text starts (one more at the end)."""
    part = pa.compute.fill_null(batch.column(column).slice(begin, end - begin), "").cast(pa.large_string())
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
    data = part.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = U64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, U64), np.full(size, U64(pow(int(BASE), -1, 1 << 64)), U64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; ``span_hash`` takes those of spans from them."""
    return prefix_sums(BYTE_VALUE[data])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """``prefix_hashes`` of any units that have 64-bit values."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever it lies."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(U64))


# ---------------------------------------------------------------- semi-join reduction

BITS_A_KEY = 16
MOST_BITS = 1 << 30


def bitmap_bits(n: int) -> int:
    """Bits of a bitmap for ``n`` keys: sixteen a key, so that one foreign key in sixteen passes, up to 128 MB."""
    return min(MOST_BITS, max(1 << 12, 1 << (BITS_A_KEY * max(1, n) - 1).bit_length()))


def bitmap_words(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(w, b): the words of the bitmap of a column of hashes that have a bit set."""
    words = keys.selectExpr(f"cast(shiftright(`{column}` & {bits - 1}L, 6) as int) AS w", f"shiftleft(1L, cast(`{column}` & 63L as int)) AS b")
    return words.groupBy("w").agg(F.bit_or("b").alias("b"))


class KeyBitmap:
    """Which hashes may be among the keys of a written table: a bitmap sized by their number.

    It never misses a key; it lets some others through, more of them when the keys are so
    many that its greatest size is reached.  So it is only put before an exact join, to
    keep rows out of its shuffle.
    """

    def __init__(self, keys: DataFrame, column: str):
        bits = bitmap_bits(keys.count())
        self.mask = bits - 1
        found = bitmap_words(keys, column, bits).toArrow()  # at most bits / 64 rows
        bitmap = np.zeros(bits // 64, U64)
        bitmap[found.column("w").to_numpy()] = found.column("b").to_numpy().view(U64)
        self.shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(U64) & U64(self.mask)
        return (self.shared.value[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def _marked(docs: DataFrame, own: Column, few: DataFrame, key: str) -> tuple[DataFrame, str, Column]:
    """``docs`` with ``own`` in a column, that column, and whether the bitmap of a written table's keys has it; in the JVM, without a shuffle.

    The bitmap's words, at most ``MOST_BITS / 64`` rows, are broadcast.
    """
    mine, h, w, b = (free_name(docs, n) for n in ("own__", "hash__", "word__", "bits__"))
    bits = bitmap_bits(few.count())
    words = bitmap_words(few.select(F.xxhash64(key).alias("k")), "k", bits).select(F.col("w").alias(w), F.col("b").alias(b))
    marked = docs.withColumn(mine, own).withColumn(h, F.xxhash64(mine))
    marked = marked.join(F.broadcast(words), F.expr(f"cast(shiftright({h} & {bits - 1}L, 6) as int) = {w}"), "left")
    return marked, mine, F.expr(f"coalesce((shiftright({b}, cast({h} & 63L as int)) & 1L) = 1L, false)")


def probable(docs: DataFrame, own: Column, few: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` that may have a key of a written table: all that have one, and few others."""
    marked, _, hit = _marked(docs, own, few, key)
    return marked.filter(hit).select(*[F.col(f"`{c}`") for c in docs.columns])


def join_few(docs: DataFrame, own: Column, few: DataFrame, key: str) -> DataFrame:
    """``docs`` left-joined with the rows of a written table that few of them match, by null-safe equality.

    Rows that a bitmap of the table's keys leaves out stay where they are, with nulls; only
    the others are shuffled for the exact join.  Keys are unique.
    """
    marked, mine, hit = _marked(docs, own, few, key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = marked.filter(~hit).select(*columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema])
    some = marked.filter(hit).select(*columns, mine).join(few, F.col(mine).eqNullSafe(F.col(key)), "left").drop(mine)
    return rest.unionByName(some)


def filter_lists(lists: pa.ListArray, keep: np.ndarray, *others: pa.ListArray) -> list[pa.ListArray]:
    """List columns of one shape without the items that ``keep`` (over all items) leaves out."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    total = np.r_[0, np.cumsum(keep)]
    base = offsets[0]
    new = pa.array((total[offsets - base]).astype(np.int32))
    return [pa.ListArray.from_arrays(new, x.flatten().filter(pa.array(keep))) for x in (lists, *others)]


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every end of an edge (a, b): comp is the least node of its component.

    Labels go to the least label among neighbours, then to their label's label, until
    none changes.  Every round is a written table; the joins take their sides straight
    from tables, so that adaptive execution can split a hub's rows.
    """
    links = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-links")
    labels = written(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), f"{name}-labels")
    for _ in range(max_rounds):
        near = links.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = written(labels.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")), f"{name}-low")
        up = low.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        labels = written(low.join(up, "comp", "left").select("node", "was", F.least(F.col("comp"), F.col("above")).alias("comp")), f"{name}-labels")
        if labels.filter("was <> comp").isEmpty():
            return labels.select("node", "comp")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def crc_of_text(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))
