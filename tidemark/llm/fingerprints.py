"""Operator 9, document fingerprints from improbable features.

Every window of ``WINDOW`` bytes has a rarity, its Shannon entropy from local byte
counts, ranked against how common such entropies are.  A window is a feature when it
is the leftmost rarest among its ``2 * REACH + 1`` neighbours, so that a text of one
repeated byte or of a short period has one feature.  A text shorter than a window is one
feature; the empty text alone has none.  A feature sets ``HASHES`` bits of a Bloom filter of ``BITS`` bits; after
``FULL`` features the next filter of the chain begins.  Two fingerprints are compared
filter by filter: the bits in common beyond those expected by chance, as a share of the
most that there could be, averaged over the filters of the shorter chain.

All of it is local: a window's rarity depends on its own bytes only, so an edit changes
only the features near it, and equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, U64, free_name, in_arrow, mix, others, text_slices, texts_of

WINDOW, REACH = 64, 24
BITS, HASHES, FULL = 2048, 5, 160
BLOCK = 1 << 16
_count = np.arange(WINDOW + 1, dtype=np.float64)
_gain = np.zeros(WINDOW + 1, np.int32)  # what the n-th equal byte adds to sum(c * log2 c), in fixed point
_gain[1:] = np.round(np.diff(_count * np.log2(np.maximum(_count, 1))) * 4096)


def entropies(data: np.ndarray) -> np.ndarray:
    """sum(c * log2 c) over the byte counts c of every window; small where entropy is high."""
    n = len(data) - WINDOW + 1
    before, after = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = data[d:] == data[:-d]
        before[d:] += same
        after[:-d] += same
    first = int(_gain[before_within(data[:WINDOW])].sum())
    out = np.empty(n, np.int32)
    out[0] = first
    # the window moves on: its first byte leaves, the next one comes; both counts are within the wider or the new window
    leave = _gain[after[: n - 1]]
    come = before[WINDOW:]
    out[1:] = first + np.cumsum(_gain[come] - leave)
    return out


def before_within(data: np.ndarray) -> np.ndarray:
    """How often each byte has come so far, itself included."""
    return np.array([int((data[: i + 1] == data[i]).sum()) for i in range(len(data))])


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the chosen windows of all texts, and the text of each, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    short = [i for i, t in enumerate(texts) if 0 < len(t) < WINDOW]  # one feature, the whole text
    hashes = [np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in short], U64)]
    owner = [np.array(short, np.int64)]
    for base in range(0, len(data) - WINDOW + 1, BLOCK):  # what a block chooses depends on REACH windows on either side
        lo, hi = max(0, base - REACH), min(len(data), base + BLOCK + WINDOW - 1 + REACH)
        part = data[lo:hi]
        level = entropies(part)
        first = lo + np.arange(len(level))
        own = np.searchsorted(stops, first, "right")
        # least sum of c * log2 c is most improbable; ties go by content, then to the left
        wide = np.lib.stride_tricks.sliding_window_view(part, 8)[: len(level)]
        content = mix(np.ascontiguousarray(wide).view("<u8").ravel())
        rank = (level.astype(np.int64) << 20) | (content & U64(0xFFFFF)).astype(np.int64)
        whole = first + WINDOW <= stops[np.minimum(own, len(stops) - 1)]  # not across two texts
        top = np.iinfo(np.int64).max
        rank[~whole] = top
        pad = np.full(REACH, top)
        least = run_min(np.concatenate([pad, rank, pad]), REACH)
        n = len(rank)
        best = (rank < least[:n]) & (rank <= np.minimum(rank, least[REACH + 1 : REACH + 1 + n])) & whole
        at = np.flatnonzero(best & (first >= base) & (first < base + BLOCK))
        rows = np.lib.stride_tricks.sliding_window_view(part, WINDOW)[at]
        words = np.ascontiguousarray(rows).view("<u8").reshape(-1, WINDOW // 8)
        h = np.zeros(len(at), U64)
        for k in range(WINDOW // 8):
            h = mix(h * U64(0x9E3779B97F4A7C15) + words[:, k])
        hashes.append(h)
        owner.append(own[at])
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order]


def run_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    n, span, low = len(values) - width + 1, 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[width - span : width - span + n])


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """Chain of Bloom filters of every text, one row of bytes for each filter."""
    h, owner = features(texts)
    count = np.bincount(owner, minlength=len(texts))
    chains = -(-count // FULL)
    first = np.r_[0, np.cumsum(chains)]
    turn = np.arange(len(h)) - np.r_[0, np.cumsum(count)][owner]
    bits = np.zeros(int(first[-1]) * BITS, bool)
    base = (first[owner] + turn // FULL) * BITS
    for k in range(HASHES):
        bits[base + ((h >> U64(11 * k)) & U64(BITS - 1)).astype(np.int64)] = True
    rows = np.packbits(bits).reshape(-1, BITS // 8)
    return [rows[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def chain_of(text: str) -> np.ndarray:
    return digests([text.encode("utf-8", "surrogatepass")])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bits in common beyond chance, as a share of the most possible; 0 to 1."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for row, n in zip(a, na.tolist(), strict=True):
        common = np.bitwise_count(b & row).sum(1, dtype=np.int64)
        most = np.minimum(n, nb)
        chance = n * nb / BITS
        total += float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(a)


def shown(chain: np.ndarray) -> str:
    return f"{len(chain)}:" + base64.b64encode(chain.tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    count, _, body = fingerprint.partition(":")
    return np.frombuffer(base64.b64decode(body), np.uint8).reshape(int(count), BITS // 8)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` (null: as empty); a column named like it gives way; no shuffle."""
    inner = free_name(docs, "t__")
    kept = docs.withColumn(inner, F.col(f"`{text}`")).select(*[F.col(f"`{c}`") for c in [*others(docs, [out]), inner]])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for begin, end in text_slices(batch, inner):
                found += [shown(c) for c in digests([t.encode("utf-8", "surrogatepass") for t in texts_of(batch, inner, begin, end)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[*batch.schema.names[:-1], out])

    return in_arrow(kept, run, f"{fields}`{out}` string")


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the first as many characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited form, with the likeness to it and to the next text.

    Next: ascending key (null keys first, equal keys by the text's SHA-256), after the
    last the first; a table of one row is its own next, an empty table gives an empty one.
    A null text is empty.  Keys are whole numbers.  Rows are dealt out by ranges of key and
    digest, so that a key that many rows share (or null) is split; each range's first row is
    also sent to the range before it, and a streaming pass over a sorted partition sees
    all neighbours.  The driver learns one row per range.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(source, parts)
    part = _bucket(F.col("key"), F.conv(F.substr(F.sha2("t", 256), F.lit(1), F.lit(8)), 16, 10).cast("long"), cuts)
    placed = source.select("key", "t", part.alias("part"))
    order = F.struct(F.col("key").isNotNull().alias("k"), F.col("key").alias("v"), F.sha2("t", 256).alias("s"))
    firsts = placed.groupBy("part").agg(F.min(order).alias("first")).select("part", "first.*").collect()  # a row for each range
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    ranges = sorted((r["part"], r["k"], r["v"], r["s"]) for r in firsts)
    before = {ranges[i][0]: ranges[i - 1][0] for i in range(len(ranges))}
    heads = spark.createDataFrame([(p, k, v, s, before[p]) for p, k, v, s in ranges], "part int, k boolean, v long, s string, before int")
    guest = F.broadcast(heads.withColumnRenamed("part", "p"))
    is_first = (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("v"))
    tagged = placed.join(guest, is_first, "left")
    tagged = tagged.withColumn("to", F.when(F.col("s") == F.sha2("t", 256), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")))))
    dealt = tagged.select("key", "t", F.explode("to").alias("to")).select("key", "t", "to.part", "to.guest")
    ordered = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", F.asc_nulls_first("key"), F.sha2("t", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, key, text, chain) that waits for its next
        queue: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch | None:
            nonlocal held, queue, size
            chains = digests([t.encode("utf-8", "surrogatepass") for _, _, t, _ in queue])
            pairs = []
            for (part, key, text, guest), chain in zip(queue, chains, strict=True):
                if held is not None and held[0] == part:
                    pairs.append((held, text, chain))
                elif guest:
                    continue
                held = (part, key, text, chain) if not guest else None
            queue, size = [], 0
            if not pairs:
                return None
            changed = [edited(one[2], following) for one, following, _ in pairs]
            other = digests([c.encode("utf-8", "surrogatepass") for c in changed])
            rows = [
                (one[1], len(one[2]), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), shown(one[3]), shown(o), likeness(one[3], o), likeness(one[3], chain))
                for (one, _, chain), c, o in zip(pairs, changed, other, strict=True)
            ]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for key, text, part, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                queue.append((part, key, text, guest))
                size += len(text)
                if size > SLICE_BYTES and (out := flush()) is not None:
                    yield out
        if queue and (out := flush()) is not None:
            yield out

    return in_arrow(ordered, run, _SCHEMA)


_SCHEMA = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _cuts(source: DataFrame, parts: int) -> list[tuple[int | None, int]]:
    """Bounds (key, first 32 bits of the digest) of about equal ranges; null keys come first.

    Quantiles need not be exact, only the same for all rows.  A key that is several
    quantiles holds so many shares of the rows and is cut by digest.
    """
    if parts < 2:
        return []
    rows, keyed = source.agg(F.count(F.lit(1)), F.count("key")).first()
    if not rows:
        return []
    nulls = round(parts * (rows - keyed) / rows)
    left = max(1, parts - nulls)
    found = [int(c) for c in source.select("key").na.drop().approxQuantile("key", [i / left for i in range(1, left)], 0.25 / left)] if keyed and left > 1 else []
    out: list[tuple[int | None, int]] = [(None, (i << 32) // max(1, nulls)) for i in range(1, nulls)]
    if keyed and nulls:
        out.append((-(1 << 63), 0))
    for k in sorted(set(found)):
        times = found.count(k)
        out += [(k, (i << 32) // times) for i in range(times)]
    return out


def _bucket(key, digest, cuts: list[tuple[int | None, int]]):
    """Number of cuts at or below (key, digest), by binary search."""

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        k, d = cuts[mid]
        above = key.isNotNull() | (digest >= d) if k is None else F.coalesce((key > k) | ((key == k) & (digest >= d)) if d else key >= k, F.lit(False))
        return F.when(above, search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(cuts))


def op9_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited form and their likeness, as ``compare_with_next`` gives them."""
    return compare_with_next(docs).withColumnRenamed("key", "doc_id")
