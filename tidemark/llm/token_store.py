"""Operator 8, token ids in binary shards with a minimal perfect hash index.

A shard holds the ids of a range of documents in ascending key order, raw and little
endian, in two bytes an id if the vocabulary allows it.  Its layout:

    magic, header length (u32), header (JSON: numbers of rows and ids, id width)
    payload               ids of all rows
    keys    i64 x rows    (null keys: least value, marked)
    nulls   u8  x rows
    stops   u64 x rows    ids up to the end of each row, in this shard

The index lies beside the shards, dealt by a hash of the key into files of about
``BUCKET_KEYS`` keys, each a minimal perfect hash of its distinct keys: a level is a bit
array in which keys that nobody collides with set their bit; the others go on to the next
level.  A key's slot is the rank of its bit:

    magic, header length (u32), header (JSON: numbers of keys and runs, hash levels)
    words   u64 ...       the hash levels' bit arrays
    ranks   u64 ...       ones before each word of them
    prints  u16 x keys    fingerprint of the key in that slot
    keys    i64 x keys    the key itself, so that a foreign key never passes
    first   u32 x keys+1  first run of that slot
    runs    part, number (u32), row, rows (u32), at, ids (u64)

A run is a row of neighbours with the key in one shard: how many they are, and the byte
where the first one's ids lie in the shard's file.  So lookup of a key takes one index
file, a constant number of its words and one read of the shard, however many shards there
are; only a key that many rows share has more runs.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import byte_bpe
from tidemark.llm.common import U64, in_arrow, mix, text_slices, texts_of, work_path, written

MAGIC, INDEX_MAGIC = b"TIDESHRD", b"TIDEINDX"
END_ID = 0
NO_KEY = np.iinfo(np.int64).min
BUCKET_KEYS = 1 << 16
MOST_TASKS = 20_000
RUN = np.dtype([("part", "<u4"), ("number", "<u4"), ("row", "<u4"), ("rows", "<u4"), ("at", "<u8"), ("ids", "<u8")])


def level_hash(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys.view(U64) ^ mix(np.array([level + 1], U64))) % U64(bits)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U64) * U64(0x9E3779B97F4A7C15) + U64(77)) >> U64(48)).astype(np.uint16)


def build_index(keys: np.ndarray, gamma: float = 2.0):
    """Minimal perfect hash of distinct keys: (bits of each level, all words, ranks)."""
    sizes, words, left = [], [], keys
    while len(left):
        bits = max(64, -(-int(len(left) * gamma) // 64) * 64)
        at = level_hash(left, len(sizes), bits).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        sizes.append(bits)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    flat = np.concatenate(words) if words else np.zeros(0, "<u8")
    ones = np.bitwise_count(flat).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    return sizes, flat, np.r_[0, np.cumsum(ones)][: len(flat)].astype("<u8")


def slots_of(keys: np.ndarray, sizes: list[int], words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Slot of every key; -1 for keys that no level places."""
    out = np.full(len(keys), -1, np.int64)
    base, todo = 0, np.arange(len(keys))
    for level, bits in enumerate(sizes):
        if not len(todo):
            break
        at = level_hash(keys[todo], level, bits).astype(np.int64)
        word, bit = base // 64 + at // 64, (at % 64).astype(U64)
        hit = (words[word] >> bit) & U64(1) == 1
        below = np.bitwise_count(words[word] & ((U64(1) << bit) - U64(1)))
        out[todo[hit]] = (ranks[word] + below)[hit].astype(np.int64)
        todo = todo[~hit]
        base += bits
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Index file of every key."""
    return (mix(keys.view(U64) + U64(0x51ED270B)) % U64(buckets)).astype(np.int32)


def _put(path: str, content: bytes) -> None:
    """Write a file under a name of its own, then give it its place: tasks that run twice write the same bytes."""
    system, place = pafs.FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    own = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(content)
    system.move(own, place)


def _parts_of(path: str, magic: bytes):
    """Open file, header and where the content begins."""
    system, place = pafs.FileSystem.from_uri(path)
    file = system.open_input_file(place)
    start = file.read_at(12, 0)
    if start[:8] != magic:
        raise ValueError(f"not a file of this kind: {path}")
    size = struct.unpack("<I", start[8:])[0]
    return file, json.loads(file.read_at(size, 12)), 12 + size


def _head(magic: bytes, head: dict) -> bytes:
    text = json.dumps(head).encode()
    return magic + struct.pack("<I", len(text)) + text


def shard_path(path: str, part: int, number: int) -> str:
    return f"{path}/shard-{part:06d}-{number:06d}.tok"


def index_path(path: str, bucket: int) -> str:
    return f"{path}/index/{bucket % 1000:03d}/{bucket:08d}.idx"


def shard_bytes(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    kind = "<u2" if width == 2 else "<u4"
    flat = np.array([NO_KEY if k is None else k for k in keys], "<i8")
    nulls = np.array([k is None for k in keys], np.uint8)
    stops = np.cumsum([len(x) for x in ids]).astype("<u8")
    head = _head(MAGIC, {"rows": len(flat), "ids": int(stops[-1]) if len(stops) else 0, "width": width})
    return b"".join([head, *(x.astype(kind).tobytes() for x in ids), flat.tobytes(), nulls.tobytes(), stops.tobytes()])


class Shard:
    """Reader of one shard."""

    def __init__(self, path: str):
        self.file, self.head, self.payload = _parts_of(path, MAGIC)
        h = self.head
        self.kind = np.dtype("<u2" if h["width"] == 2 else "<u4")
        at = self.payload + h["ids"] * h["width"]
        for name, kind in (("keys", "<i8"), ("nulls", "u1"), ("stops", "<u8")):
            length = np.dtype(kind).itemsize * h["rows"]
            setattr(self, name, np.frombuffer(self.file.read_at(length, at), kind))
            at += length

    def starts(self) -> np.ndarray:
        return np.r_[np.zeros(1, "<u8"), self.stops[:-1]].astype(np.int64)

    def span(self, row: int) -> tuple[int, int]:
        return (int(self.stops[row - 1]) if row else 0), int(self.stops[row])

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - begin) * self.kind.itemsize, self.payload + begin * self.kind.itemsize), self.kind)


def index_bytes(keys: np.ndarray, runs: np.ndarray) -> bytes:
    """Index file of runs in ascending order of their keys; a key may have several."""
    distinct, first = np.unique(keys, return_index=True)
    sizes, words, ranks = build_index(distinct)
    slot = slots_of(distinct, sizes, words, ranks)
    order = np.argsort(slot)  # slots are 0, 1, 2 ...
    count = np.diff(np.r_[first, len(keys)])[order]
    stops = np.cumsum(count)
    at = np.repeat(first[order] - np.r_[0, stops[:-1]], count) + np.arange(len(keys))
    head = _head(INDEX_MAGIC, {"keys": len(distinct), "runs": len(runs), "levels": sizes})
    return b"".join([head, words.tobytes(), ranks.tobytes(), fingerprints(distinct)[order].astype("<u2").tobytes(), distinct[order].astype("<i8").tobytes(), np.r_[0, stops].astype("<u4").tobytes(), runs[at].tobytes()])


class Index:
    """Reader of one index file."""

    def __init__(self, path: str):
        file, h, at = _parts_of(path, INDEX_MAGIC)
        self.levels, words = h["levels"], sum(h["levels"]) // 64
        for name, kind, n in (("words", "<u8", words), ("ranks", "<u8", words), ("prints", "<u2", h["keys"]), ("keys", "<i8", h["keys"]), ("first", "<u4", h["keys"] + 1), ("runs", RUN, h["runs"])):
            length = np.dtype(kind).itemsize * n
            setattr(self, name, np.frombuffer(file.read_at(length, at), kind))
            at += length
        file.close()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 for keys that are not in the index."""
        out = slots_of(keys, self.levels, self.words, self.ranks)
        placed = np.flatnonzero(out >= 0)
        same = self.prints[out[placed]] == fingerprints(keys[placed])
        out[placed[~same]] = -1
        placed = placed[same]
        out[placed[self.keys[out[placed]] != keys[placed]]] = -1
        return out


class TokenStore:
    """A written store: its folder, how many index files it has, and per partition what came before it."""

    def __init__(self, path: str, buckets: int, width: int, manifest: DataFrame | None = None):
        self.path, self.buckets, self.width, self.manifest = path, buckets, width, manifest
        self.indexes: dict[int, Index] = {}

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the first row with this key, None if there is none: one index file, one read of one shard."""
        one = np.array([key], np.int64)
        bucket = int(bucket_of(one, self.buckets)[0])
        if bucket not in self.indexes:
            try:
                self.indexes[bucket] = Index(index_path(self.path, bucket))
            except FileNotFoundError:  # no key fell into this file
                return None
        index = self.indexes[bucket]
        slot = int(index.slots(one)[0])
        if slot < 0:
            return None
        run = index.runs[index.first[slot]]
        system, place = pafs.FileSystem.from_uri(shard_path(self.path, int(run["part"]), int(run["number"])))
        with system.open_input_file(place) as f:
            return np.frombuffer(f.read_at(int(run["ids"]) * self.width, int(run["at"])), f"<u{self.width}")


def write_store(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.json", shard_tokens: int = 1 << 25, bucket_keys: int = BUCKET_KEYS) -> TokenStore:
    """Write shards under ``path`` in ascending key order (null keys first, ties by a hash of the text, then the text), then their index.

    Keys are whole numbers; other types are refused.  A null or empty text is its end id.
    Repeated keys and rows stay rows of their own; an empty table gives a store without
    shards.  Null keys are stored but have no place in the index; ``read_keys`` finds
    them in the manifest.  The driver gets one row for each range of keys.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
    if source.schema["key"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("keys of a token store are whole numbers")
    path, spark = path.rstrip("/"), docs.sparkSession
    first = F.asc_nulls_first("key")
    hashed = source.select(F.col("key").cast("long").alias("key"), F.xxhash64("t").alias("h"), "t")
    ordered = hashed.repartitionByRange(first, "h").sortWithinPartitions(first, "h", "t")  # rows of one key are split, too
    with_ids = byte_bpe(vocabulary)
    width = 2 if max(with_ids.size, end_id + 1) <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bpe, number, before = TaskContext.get().partitionId(), byte_bpe(vocabulary), 0, 0
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, number, before
            _put(shard_path(path, part, number), shard_bytes(keys, ids, width))
            row = {"part": part, "number": number, "rows": len(keys), "nulls": keys.count(None), "ids": held, "before": before}
            keys, ids, held, number, before = [], [], 0, number + 1, before + held
            return pa.RecordBatch.from_pylist([row], schema=manifest)

        for batch in batches:
            for begin, end in text_slices(batch, "t"):
                for k, text in zip(batch.column(0).slice(begin, end - begin).to_pylist(), texts_of(batch, "t", begin, end), strict=True):
                    one = np.append(bpe.encode(text), np.uint32(end_id)).astype(np.uint16 if width == 2 else np.uint32)
                    keys.append(k)
                    ids.append(one)
                    held += len(one)
                    if held >= shard_tokens:
                        yield flush()
        if keys:
            yield flush()

    manifest = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("rows", pa.int64()), ("nulls", pa.int64()), ("ids", pa.int64()), ("before", pa.int64())])
    done = written(in_arrow(ordered.select("key", "t"), write, "part int, number int, rows long, nulls long, ids long, before long"), "token-manifest")
    # a row for each range of keys: ids and shards before it
    ranges = sorted(tuple(r) for r in done.groupBy("part").agg(F.sum("ids"), F.count(F.lit(1))).collect())
    table, ids, shards = [], 0, 0
    for part, n, files in ranges:
        table.append((part, ids, shards))
        ids, shards = ids + n, shards + files
    place = spark.createDataFrame(table, "part int, ids_before long, shards_before long")
    done = done.join(F.broadcast(place), "part")
    done = written(done.select("part", "number", "rows", "nulls", (F.col("before") + F.col("ids_before")).alias("before"), (F.col("number") + F.col("shards_before")).alias("shard")), "token-shards")
    rows = done.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    buckets = max(1, -(-rows // bucket_keys))
    _write_index(done, path, buckets, width, shards)
    return TokenStore(path, buckets, width, done)


def _tasks(n: int) -> int:
    return max(1, min(n, MOST_TASKS))


def _write_index(shards: DataFrame, path: str, buckets: int, width: int, count: int) -> None:
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number in zip(batch.column("part").to_pylist(), batch.column("number").to_pylist(), strict=True):
                shard = Shard(shard_path(path, part, number))
                some = np.flatnonzero(shard.nulls == 0)
                keys, starts = shard.keys[some], shard.starts()
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
                row = some[first]
                n = len(row)
                columns = [bucket_of(keys[first], buckets), keys[first], np.full(n, part, np.int32), np.full(n, number, np.int32), row, np.diff(np.r_[first, len(keys)]), shard.payload + starts[row] * width, shard.stops[row].astype(np.int64) - starts[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [f.type for f in schema], strict=True)], schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("row", pa.int64()), ("rows", pa.int64()), ("at", pa.int64()), ("ids", pa.int64())])
    found = in_arrow(shards.select("part", "number").repartition(_tasks(count)), runs, "bucket int, key long, part int, number int, row long, rows long, at long, ids long")
    tasks = _tasks(buckets)
    dealt = found.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket", "key", "part", "number")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in _by_first(batches):
            runs = np.zeros(table.num_rows, RUN)
            for name in RUN.names:
                runs[name] = table.column(name).to_numpy()
            _put(index_path(path, bucket), index_bytes(table.column("key").to_numpy(), runs))
            yield pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64())], names=["runs"])

    in_arrow(dealt, build, "runs long").agg(F.sum("runs")).collect()


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows by the value of the first column, by which they are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        value = batch.column(0).to_numpy()
        cuts = np.flatnonzero(value[1:] != value[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(value)], strict=True):
            if b > a:
                if held and held[0].column(0)[0].as_py() != value[a]:
                    yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def read_keys(spark: SparkSession, store: TokenStore, keys: DataFrame) -> DataFrame:
    """key, start (ids in all rows before), n_tokens and the raw ids' CRC-32 as 32-bit numbers, of all rows with one of ``keys``.

    ``keys`` is one column.  Every distinct key is looked up in the index: file by hash,
    slot, fingerprint, runs.  The runs go to the shards they name, and each shard is read in
    the order of its rows.  A key that is not in the store gives no row; a null key gives
    the rows with null keys, which the manifest places.
    """
    path, buckets = store.path, store.buckets
    wanted = keys.select(F.col(f"`{keys.columns[0]}`").cast("long").alias("key"))
    count = store.manifest.count()

    def placed(batch_keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket_of(batch_keys, buckets)), pa.array(batch_keys)], names=["bucket", "key"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield placed(batch.column(0).to_numpy())

    tasks = _tasks(buckets)
    dealt = in_arrow(wanted.filter("key is not null").distinct(), deal, "bucket int, key long")
    dealt = dealt.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in _by_first(batches):
            try:
                index = Index(index_path(path, bucket))
            except FileNotFoundError:  # no key fell into this file
                continue
            own = table.column("key").to_numpy()
            slot = index.slots(own)
            slot = slot[slot >= 0]
            begin, end = index.first[slot].astype(np.int64), index.first[slot + 1].astype(np.int64)
            n = end - begin
            at = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            runs = index.runs[at]
            yield pa.RecordBatch.from_arrays([pa.array(runs[c].astype(np.int64)) for c in ("part", "number", "row", "rows")], names=["part", "number", "row", "rows"])

    runs = in_arrow(dealt, look_up, "part long, number long, row long, rows long")
    if not wanted.filter("key is null").isEmpty():
        runs = runs.union(store.manifest.filter("nulls > 0").selectExpr("cast(part as long)", "cast(number as long)", "0L", "nulls"))
    shards = store.manifest.select(F.col("part").cast("long").alias("part"), F.col("number").cast("long").alias("number"), "before", "shard")
    files = _tasks(count)
    here = runs.join(shards, ["part", "number"]).select("shard", "part", "number", "before", "row", "rows")
    here = here.repartitionById(files, (F.col("shard") % files).cast("int")).sortWithinPartitions("shard", "row")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _by_first(batches):
            part, number, before = (table.column(c)[0].as_py() for c in ("part", "number", "before"))
            shard = Shard(shard_path(path, part, number))
            row, n = table.column("row").to_numpy(), table.column("rows").to_numpy()
            rows = np.repeat(row - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            starts = shard.starts()
            cuts = np.unique(np.r_[np.flatnonzero(np.diff(rows) != 1) + 1, np.arange(0, len(rows), 4096), len(rows)])
            found: list[tuple] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # neighbours are read at once
                some = rows[a:b]
                base, stop = int(starts[some[0]]), int(shard.stops[some[-1]])
                ids = shard.ids(base, stop).astype("<u4")
                for r in some.tolist():
                    x, y = shard.span(r)
                    found.append((None if shard.nulls[r] else int(shard.keys[r]), before + x, y - x, zlib.crc32(ids[x - base : y - base].tobytes())))
                if len(found) >= 4096 or b == len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["key", "start", "n_tokens", "ids_crc32"])
                    found = []

    return in_arrow(here, read, "key long, start long, n_tokens long, ids_crc32 long")


def op8_token_store(docs: DataFrame) -> DataFrame:
    """Place, length and checksum of every document's ids, looked up by its key in a store written for the purpose."""
    spark = docs.sparkSession
    store = write_store(docs, work_path(spark, "token-store"))
    return read_keys(spark, store, docs.select("doc_id")).withColumnRenamed("key", "doc_id")
