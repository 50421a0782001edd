"""Operator 10, removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are told apart through ``threshold`` bytes only, most significant digit first,
and only where a window can be told apart at all:

Digit 1 is a ``gram`` of bytes inside the window: the one with the least hash, leftmost
on ties.  It depends on the window's bytes alone, so equal windows have equal grams
at equal places, and the suffixes of a document share few grams (about two in every
``threshold - gram`` bytes).  Classes with one member leave here; counting them is one
pre-aggregated shuffle of 16-byte rows.
The further digits are eight bytes each, exact bytes: the members of a class bring the
bytes around their gram, and the suffixes from the gram on, and likewise the bytes before
it read backwards, are ordered by most-significant-digit passes; a member that is alone
leaves the passes.  The depth to which neighbours agree then gives, for each place of the
gram in the window, the groups of equal windows: those that agree so many bytes backwards
and the rest forwards.  Groups of two or more are exactly the repeated windows.

A class of any size is dealt in blocks of about ``block`` members.  What is repeated in
its block is known there; of a class with several blocks, one window of each group and
those that are alone in their block go on, in bands of ``BAND`` neighbouring places.  A band
whose common bytes no other member has leaves; the windows of the others meet in an
aggregation by a 128-bit cryptographic digest of all their bytes.

Windows of ``words`` words go the same way beside those of bytes, if asked for: their
units are the 64-bit hashes of words, so that white space doesn't count.  A gram's
lowest bit tells the two kinds apart.

Texts that equal another text are one node; a whole text of at least one window with
a copy is all repeated.  Nothing is collected by the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, KeyBitmap, bytes_of, column_of, filter_lists, free_name, in_arrow, join_few, map_batches, mix, prefix_hashes, prefix_sums, span_hash, text_slices, written
from tidemark.llm.near_dup import words as words_of

THRESHOLD = 400
GRAM = 128
BLOCK = 16_000
PLACE = 20  # bits
DIGIT = 8  # bytes
BAND = 32  # places of a gram in its window that are looked at together
CONTEXT_BYTES = 2 << 20  # of a batch of contexts


def prefixes(units: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of bytes, or of words given by their hashes."""
    return prefix_hashes(units) if units.dtype == np.uint8 else prefix_sums(units)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Places of the leftmost least value of every ``width`` consecutive ones; values count by their upper bits."""
    n = len(values) - width + 1
    low = ((values >> U64(PLACE)) << U64(PLACE)) | np.arange(len(values), dtype=U64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n]) & U64((1 << PLACE) - 1)
    return low[np.r_[True, low[1:] != low[:-1]]].astype(np.int64)


def anchors(data: np.ndarray, threshold: int = THRESHOLD, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Grams (hash, place) of one text, its bytes or the hashes of its words, that some window takes as its first digit, and spans known to be repeated.

    In a stretch of a short period all windows equal the one a period later; its inner
    grams are left out and the stretch is returned instead.
    """
    if len(data) < threshold:
        return np.zeros(0, U64), np.zeros(0, np.int64), []
    ats, values = [], []
    block = 1 << (PLACE - 1)
    for base in range(0, len(data) - threshold + 1, block):  # each window lies in one block
        part = data[base : base + block + threshold - 1]
        prefix = prefixes(part)
        starts = np.arange(len(part) - gram + 1)
        hashes = span_hash(prefix, starts, starts + gram)
        at = sliding_argmin(hashes, threshold - gram + 1)
        ats.append(at + base)
        values.append(hashes[at])
    at, found = np.concatenate(ats), np.concatenate(values)
    if len(ats) > 1:
        at, first = np.unique(at, return_index=True)
        found = found[first]
    gaps = np.diff(at)
    same = (found[1:] == found[:-1]) & (gaps <= 64)
    spans: list[tuple[int, int]] = []
    if same.any():
        keep = np.ones(len(at), bool)
        # runs of equal grams at equal distances
        step = np.where(same, gaps, 0)
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lo, hi = int(at[i]), int(at[j]) + gram
            if step[i] and hi - lo >= threshold + int(step[i]) and np.array_equal(data[lo : hi - step[i]], data[lo + step[i] : hi]):
                spans.append((lo, hi))
                keep[i : j + 1] &= (at[i : j + 1] - (threshold - gram) < lo) | (at[i : j + 1] + threshold > hi)
        at, found = at[keep], found[keep]
    return found, at, spans


def radix_order(head: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their head, then by their digits, most significant first; and how many digits each row shares with the one before it.

    A row shares -1 digits with one of another head.  A pass looks only at rows that
    still have a neighbour with the same digits so far.
    """
    n, width = digits.shape
    order = np.argsort(head, kind="stable")
    depth = np.full(n, width, np.int64)
    depth[:1] = -1
    ranked = head[order]
    depth[1:][ranked[1:] != ranked[:-1]] = -1
    for d in range(width):
        run = np.cumsum(depth < width)
        alone = depth < width
        alone[:-1] &= depth[1:] < width
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        value, own = digits[order[at], d], run[at]
        turn = np.lexsort((value, own))
        order[at] = order[at][turn]
        value = value[turn]
        split = np.flatnonzero((own[1:] == own[:-1]) & (value[1:] != value[:-1])) + 1
        depth[at[split]] = d
    return order, depth


def agreements(head: np.ndarray, units: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the spans that start at ``begin`` and go ``step`` (1 or -1) unit by unit, to a depth of ``width`` units; and the units each shares with the one before it.

    A span shorter than ``width`` is filled up; what it is compared with beyond its
    length doesn't count for any of its windows.
    """
    per = DIGIT // units.dtype.itemsize
    digits = np.zeros((len(head), -(-width // per)), U64)
    for first in range(0, len(head), 1024):
        rows = slice(first, first + 1024)
        reach = np.arange(digits.shape[1] * per)
        at = begin[rows, None] + step * reach
        inside = (reach < np.minimum(length[rows], width)[:, None])
        got = np.where(inside, units[np.where(inside, at, 0)], units.dtype.type(0)) if len(units) else np.zeros(inside.shape, units.dtype)
        digits[rows] = np.ascontiguousarray(got).view(">u8" if per > 1 else U64).reshape(got.shape[0], -1)
    order, depth = radix_order(head, digits)
    if per > 1:  # whole units inside the digit where two rows part
        full = depth == digits.shape[1]
        parted = np.flatnonzero((depth >= 0) & (depth < digits.shape[1]))
        x = digits[order[parted], depth[parted]] ^ digits[order[parted - 1], depth[parted]]
        same = np.zeros(len(x), np.int64)
        for k in range(1, per):
            same += x < (U64(1) << U64(8 * (per - k)))
        depth[parted] = depth[parted] * per + same
        depth[full] = digits.shape[1] * per
    return order, depth


def equal_windows(contexts: list[bytes], inside: np.ndarray, head: np.ndarray, own: np.ndarray, threshold: int, gram: int, unit: type = np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """By row and by the gram's place in the window: which windows equal one of another owner, and which stand for those equal to them.

    ``inside``: the gram's place in each context.  A window of one row stands for its
    group if it is the first of it; one that is alone stands for itself.
    """
    n, places = len(contexts), threshold - gram + 1
    sizes = np.array([len(c) for c in contexts], np.int64) // np.dtype(unit).itemsize
    units = np.frombuffer(b"".join(contexts), unit)
    begin = np.r_[0, np.cumsum(sizes)[:-1]] + inside
    _, head = np.unique(head, return_inverse=True)
    forth, forth_depth = agreements(head, units, begin, sizes - inside, threshold, 1)
    back, back_depth = agreements(head, units, begin - 1, inside, places - 1, -1)

    def most(order, depth):
        out = np.empty(n, np.int64)
        out[order] = np.maximum(depth, np.r_[depth[1:], -1])
        return out

    k = np.arange(places)
    real = (k <= inside[:, None]) & (threshold - k <= (sizes - inside)[:, None])
    low = threshold - most(forth, forth_depth)  # windows of a smaller place part from all others after the gram
    high = most(back, back_depth)
    twice, stands = np.zeros(real.shape, bool), real.copy()
    code = np.empty((2, n), np.int64)
    for p in range(places):
        rows = np.flatnonzero(real[:, p] & (low <= p) & (high >= p))
        if len(rows) < 2:
            continue
        code[0, forth] = np.cumsum(forth_depth < threshold - p)
        code[1, back] = np.cumsum(back_depth < p)
        group = code[0, rows] * (n + 1) + code[1, rows]
        order = np.argsort(group)
        g, o = group[order], own[rows[order]]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        several = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
        size = np.diff(np.r_[first, len(g)])
        hit = rows[order]
        twice[hit, p] = np.repeat(several, size)
        later = np.ones(len(g), bool)
        later[first] = False
        stands[hit[later], p] = False
    return twice, stands


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the spans."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return begin[new], end[np.r_[new[1:] - 1, len(end) - 1]]


def remove_spans(data: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    edges = [0, *np.column_stack([begin, end]).ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, few of them as Python objects at a time."""
    for first in range(0, batch.num_rows, 16):
        yield from batch.slice(first, 16).to_pylist()


def contexts(batches: Iterator[pa.RecordBatch], kinds: list[tuple[int, int, type]]) -> Iterator[pa.RecordBatch]:
    """The units around every gram (``at``) of compressed texts, in batches of about ``CONTEXT_BYTES``, however many grams a text has.

    Contexts overlap, so a batch of texts has many times its own bytes of them.
    """
    import zstandard

    types = {"node": pa.binary(), "gram": pa.int64(), "place": pa.int32(), "lo": pa.int32(), "inside": pa.int32(), "blocks": pa.int32(), "context": pa.binary()}
    out: list[list] = [[] for _ in types]
    size = 0

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types.values(), strict=True)], names=list(types))

    for batch in batches:
        for row in rows_of(batch):
            data = np.frombuffer(zstandard.decompress(row["z"]), np.uint8)
            units = [data] + ([words_of(data, np.array([0, len(data)]), lower=False)[0]] if any(m["gram"] & 1 for m in row["at"]) else [])
            for m in row["at"]:
                width, part, _ = kinds[m["gram"] & 1]
                lo = max(0, m["place"] - (width - part))
                around = units[m["gram"] & 1][lo : m["place"] + width].tobytes()
                for c, v in zip(out, (row["node"], m["gram"], m["place"], lo, m["place"] - lo, m["blocks"], around), strict=True):
                    c.append(v)
                size += len(around)
                if size >= CONTEXT_BYTES:
                    yield full()
                    out, size = [[] for _ in types], 0
    if out[0]:
        yield full()


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD, gram: int = GRAM, block: int = BLOCK, words: int = 0, take: str = "all"):
    """What is repeated, by text: windows of ``threshold`` bytes and, above zero, those of ``words`` words.

    Returns two tables.  ``rows``: key, node (SHA-256 of the text; a null text is
    empty) and n_bytes of every row.  ``changes``, for the texts that have any: node, the
    maximal runs of bytes covered by windows of bytes (``begins``/``ends``) and by windows of
    words (``word_begins``/``word_ends``), and the bytes ``rest`` that remain without
    both kinds, or without the first kind if ``take`` is ``bytes``.  Null or repeated keys,
    empty texts and empty tables are allowed; repeated rows are one node.
    """
    if gram % DIGIT or threshold <= gram or take not in ("all", "bytes"):
        raise ValueError("gram and threshold, or take")
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    kind = source.schema["key"].dataType.simpleString()
    # by a gram's lowest bit: units of a window and of its gram, type of a unit
    kinds = [(threshold, gram, np.uint8)] + ([(words, max(1, words // 3), U64)] if words else [])

    def digits(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, whole, edges, grams, places, sure, word_sure = [], [], [], [], [], [], [], []
        for begin, end in text_slices(batch, "t"):
            data, offsets = bytes_of(batch, "t", begin, end)
            if words:
                named, doc, first, last = words_of(data, offsets, lower=False)
                stops = np.searchsorted(doc, np.arange(len(offsets)))
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                one = data[a:b]
                found, at, spans = anchors(one, threshold, gram)
                found &= ~U64(1)
                runs, edge = [], (None, None)
                if words and stops[i + 1] - stops[i] >= words:
                    mine = slice(stops[i], stops[i + 1])
                    more, where, runs = anchors(named[mine], words, kinds[1][1])
                    found, at = np.r_[found, more | U64(1)], np.r_[at, where]
                    runs = [(int(first[mine][x]) - a, int(last[mine][y - 1]) - a) for x, y in runs]
                    edge = int(first[mine][0]) - a, int(last[mine][-1]) - a
                nodes.append(hashlib.sha256(one).digest())
                sizes.append(b - a)
                whole.append(b - a >= threshold)
                edges.append(edge)
                grams.append(found.view(np.int64))
                places.append(at.astype(np.int32))
                sure.append([x for s in spans for x in s])
                word_sure.append([x for s in runs for x in s])
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(whole, pa.bool_()), *(pa.array([e[k] for e in edges], pa.int32()) for k in (0, 1)), pa.array(grams, pa.list_(pa.int64())), pa.array(places, ints), pa.array(sure, ints), pa.array(word_sure, ints)],
            names=["key", "node", "n_bytes", "whole", "from_word", "to_word", "grams", "places", "sure", "word_sure"],
        )

    facts = written(map_batches(source, digits, f"key {kind}, node binary, n_bytes long, whole boolean, from_word int, to_word int, grams array<long>, places array<int>, sure array<int>, word_sure array<int>"), "suffix-digits")
    windows = facts.filter("whole or to_word is not null")
    # one row stands for all copies of a text
    nodes = windows.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"), F.max("n_bytes").alias("n_bytes"), F.max("whole").alias("whole"), F.max("from_word").alias("from_word"), F.max("to_word").alias("to_word"))
    nodes = written(nodes, "suffix-nodes")
    first = nodes.select(F.col("node").alias("n1"), F.col("key").alias("first"))
    # copies have equal owners, so they don't make a class of two
    own = F.xxhash64("node", "place")
    every = windows.select("node", F.explode(F.arrays_zip("grams", "places")).alias("m")).select("node", F.col("m.grams").alias("gram"), F.col("m.places").alias("place"))
    classes = every.select("gram", own.alias("own")).groupBy("gram").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    classes = written(classes.select("gram", "size", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "suffix-classes")
    members = classes.agg(F.sum("size")).first()[0] or 0
    shared = KeyBitmap(classes, "gram")

    def some_grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, places = filter_lists(batch.column(2), shared.has(batch.column(2).flatten().to_numpy()), batch.column(3))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), grams, places, batch.column(4), batch.column(5)], names=["key", "node", "grams", "places", "sure", "word_sure"])

    some = map_batches(windows.select("key", "node", "grams", "places", "sure", "word_sure"), some_grams, f"key {kind}, node binary, grams array<long>, places array<int>, sure array<int>, word_sure array<int>")
    some = some.filter("size(grams) > 0 or size(sure) > 0 or size(word_sure) > 0")
    single = some.join(first, (F.col("node") == F.col("n1")) & F.col("key").eqNullSafe(F.col("first"))).select("node", "key", "grams", "places", "sure", "word_sure")
    single = written(single, "suffix-singles")
    member = single.select("node", "key", F.explode(F.arrays_zip("grams", "places")).alias("m")).select("node", "key", F.col("m.grams").alias("gram"), F.col("m.places").alias("place"))
    wanted = member.join(classes.select("gram", "blocks"), "gram").groupBy("node", "key").agg(F.collect_set(F.struct("gram", "place", "blocks")).alias("at"))
    lone = nodes.filter("copies = 1").select("node")
    sure = single.filter("size(sure) > 0 or size(word_sure) > 0").join(lone, "node", "left_semi").select(F.col("node").alias("n2"), F.col("key").alias("k2"), "sure", "word_sure").dropDuplicates(["n2"])
    wanted = wanted.join(sure, F.col("node") == F.col("n2"), "full").select(F.coalesce("node", "n2").alias("node"), F.when(F.col("node").isNull(), F.col("k2")).otherwise(F.col("key")).alias("first"), "at", "sure", "word_sure")
    wanted = written(wanted, "suffix-wanted")
    rows = KeyBitmap(wanted.select(F.xxhash64("first").alias("k")), "k")

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        batch = batch.filter(pa.array(rows.has(batch.column(1).to_numpy())))
        squeeze = zstandard.ZstdCompressor(level=1)
        raw = batch.column("t").cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress(x) for x in raw], pa.binary()), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())], names=["key", "z", "own"])

    # texts that still have candidates, compressed
    packed = map_batches(source.select("key", F.xxhash64("key").alias("k"), "t"), pack, f"key {kind}, z binary, own binary")
    texts = packed.join(wanted, F.col("key").eqNullSafe(F.col("first")) & (F.col("own") == F.col("node")))
    texts = written(texts.select("node", "z", "at", "sure", "word_sure"), "suffix-texts")

    around = in_arrow(texts.filter("at is not null").select("node", "z", "at"), lambda batches: contexts(batches, kinds), "node binary, gram long, place int, lo int, inside int, blocks int, context binary")
    around = around.select("node", "gram", "lo", "inside", "blocks", "context", own.alias("own")).withColumn("block", F.pmod(F.xxhash64("own"), F.col("blocks")).cast("int"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        both = pa.Table.from_batches(found)
        for k in range(len(kinds)):
            table = both.filter(pa.array(both.column("gram").to_numpy() & 1 == k))
            if table.num_rows:
                yield from runs_of(table, k)

    def runs_of(table: pa.Table, kind_of: int) -> Iterator[pa.RecordBatch]:
        threshold, gram, unit = kinds[kind_of]
        lo, inside, blocks, block = (table.column(c).to_numpy().astype(np.int64) for c in ("lo", "inside", "blocks", "block"))
        owner, grams = table.column("own").to_numpy(), table.column("gram").to_numpy()
        around, nodes = table.column("context").to_pylist(), table.column("node").to_pylist()
        head = mix(mix(grams.view(U64)) + block.astype(U64))
        twice, stands = equal_windows(around, inside, head, owner, threshold, gram, unit)
        # windows of one row, by their starts; neighbours overlap, so each run is one span
        at, k = np.nonzero(twice[:, ::-1])
        if len(at):
            begin = lo[at] + inside[at] - (twice.shape[1] - 1 - k)
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (begin[1:] > begin[:-1] + threshold)])
            stop = begin[np.r_[new[1:] - 1, len(begin) - 1]] + threshold
            yield batch_of(kind_of, [nodes[i] for i in at[new].tolist()], begin[new], stop)
        # what stands for a group, where the class has other blocks: a row for each member and band of places
        size, last = np.dtype(unit).itemsize, threshold - gram
        digest = lambda i, x, y, *salt: hashlib.blake2b(around[i][x * size : y * size], digest_size=16, person=b"%d %d" % (kind_of, *salt)).digest()
        for first in range(0, len(around), 64):
            at, k = np.nonzero(stands[first : first + 64] & (blocks[first : first + 64, None] > 1))
            at += first
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (k[1:] // BAND != k[:-1] // BAND), True][: len(at) + 1]) if len(at) else np.zeros(1, np.int64)
            if len(cuts) < 2:
                continue
            rows: list[list] = [[], [], [], [], [], []]
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                i, places, low = int(at[x]), k[x:y].tolist(), int(k[x]) // BAND * BAND
                own = int(inside[i])
                # all windows of the band hold these units
                band = digest(i, own - low, own - min(low + BAND - 1, last) + threshold, low)
                for c, v in zip(rows, (nodes[i], int(lo[i]) + own, band, places, [digest(i, own - p, own - p + threshold, -1) for p in places], twice[i, k[x:y]].tolist()), strict=True):
                    c.append(v)
            yield batch_of(kind_of, rows[0], None, None, *rows[1:])

    def batch_of(kind_of, node, begin, stop, anchor=None, band=None, places=None, names=None, known=None) -> pa.RecordBatch:
        none = [None] * len(node)
        values = [(node, pa.binary()), (none if begin is None else begin.astype(np.int32), pa.int32()), (none if stop is None else stop.astype(np.int32), pa.int32()), ([kind_of == 1] * len(node), pa.bool_())]
        values += [(anchor or none, pa.int32()), (band or none, pa.binary()), (places or none, pa.list_(pa.int32())), (names or none, pa.list_(pa.binary())), (known or none, pa.list_(pa.bool_()))]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], names=["node", "b", "e", "w", "anchor", "band", "places", "names", "known"])

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), members // 16_000)
    ordered = in_arrow(around.repartition(tasks, "gram", "block"), order, "node binary, b int, e int, w boolean, anchor int, band binary, places array<int>, names array<binary>, known array<boolean>")
    spans = written(ordered, "suffix-spans")
    across, start = spans.filter("band is not null"), lambda *c: F.xxhash64(*c)
    # a band that only one member has leaves here with all its windows
    bands = written(across.select("band", start("node", "anchor").alias("at")).groupBy("band").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo <> hi").select("band"), "suffix-bands")
    single = across.join(bands, "band", "left_semi").select("node", "w", "anchor", F.explode(F.arrays_zip("places", "names", "known")).alias("x"))
    single = single.select("node", (F.col("anchor") - F.col("x.places")).alias("b"), "w", F.col("x.names").alias("h"), F.col("x.known").alias("known"))
    single = written(single, "suffix-single")
    # a window may hold grams of several classes, so its start tells owners apart
    meet = single.select("h", start("node", "b").alias("at")).groupBy("h").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo <> hi").select("h")
    width = F.when(F.col("w"), F.lit(words)).otherwise(F.lit(threshold))
    met = single.join(meet, "h", "left_semi").filter("not known").select("node", "b", (F.col("b") + width).alias("e"), "w")
    spans = spans.filter("band is null").select("node", "b", "e", "w").union(met)
    every = spans.groupBy("node").agg(F.collect_list(F.struct("b", "e", "w")).alias("found")).withColumnRenamed("node", "n2")
    lone = nodes.filter("copies = 1").select(F.col("node").alias("n3"))
    joined = texts.select("node", "z", "sure", "word_sure").join(every, F.col("node") == F.col("n2"), "left").filter("found is not null or sure is not null")
    joined = joined.join(lone, F.col("node") == F.col("n3"), "left_semi").select("node", "z", "sure", "word_sure", "found").dropDuplicates(["node"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        out: list[list] = [[], [], [], [], []]
        for row in rows_of(batch):
            found, data = row["found"] or [], zstandard.decompress(row["z"])
            flat, word_flat = row["sure"] or [], row["word_sure"] or []
            b = np.array([*flat[::2], *(x["b"] for x in found if not x["w"])], np.int64)
            e = np.array([*flat[1::2], *(x["e"] for x in found if not x["w"])], np.int64)
            wb, we = np.array(word_flat[::2], np.int64), np.array(word_flat[1::2], np.int64)
            if any(x["w"] for x in found):
                _, _, first, last = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=False)
                wb = np.r_[wb, first[[x["b"] for x in found if x["w"]]]]
                we = np.r_[we, last[[x["e"] - 1 for x in found if x["w"]]]]
            runs, word_runs = merged(b, e), merged(wb, we)
            gone = merged(np.r_[runs[0], word_runs[0]], np.r_[runs[1], word_runs[1]]) if take == "all" else runs
            for c, v in zip(out, (*runs, *word_runs, remove_spans(data, *gone)), strict=True):
                c.append(v)
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array([v.astype(np.int32) for v in c], ints) for c in out[:4]), pa.array(out[4], pa.binary())], names=["node", "begins", "ends", "word_begins", "word_ends", "rest"])

    changes = map_batches(joined, cut, "node binary, begins array<int>, ends array<int>, word_begins array<int>, word_ends array<int>, rest binary")
    # copies: all bytes of a text of at least one window, all from the first word to the last
    none = F.array().cast("array<int>")
    copied = nodes.filter("copies > 1").select(
        "node",
        F.when(F.col("whole"), F.array(F.lit(0))).otherwise(none).alias("begins"), F.when(F.col("whole"), F.array(F.col("n_bytes").cast("int"))).otherwise(none).alias("ends"),
        *[F.when(F.col(c).isNull(), none).otherwise(F.array(c)).alias(name) for c, name in (("from_word", "word_begins"), ("to_word", "word_ends"))],
        "key", "whole",
    )
    entire = copied.filter("whole").select("node", "begins", "ends", "word_begins", "word_ends", F.lit(b"").alias("rest"))
    short = copied.filter("not whole").join(facts.select(F.col("node").alias("n4"), F.col("key").alias("k4")), (F.col("node") == F.col("n4")) & F.col("key").eqNullSafe(F.col("k4")), "left_semi")
    return facts.select("key", "node", "n_bytes"), changes.union(entire).union(_short_rests(short, source, take))


def _short_rests(short: DataFrame, source: DataFrame, take: str) -> DataFrame:
    """What is left of copied texts below one window of bytes but not of words: white space at both ends, or all of them."""
    mine = short.select("node", "begins", "ends", "word_begins", "word_ends", F.col("key").alias("k5"))
    texts = source.select("key", F.col("t").cast("binary").alias("raw"))
    both = texts.join(mine, F.col("key").eqNullSafe(F.col("k5"))).filter(F.unhex(F.sha2("raw", 256)) == F.col("node")).dropDuplicates(["node"])
    ends = F.concat(F.expr("substring(raw, 1, word_begins[0])"), F.expr("substring(raw, word_ends[0] + 1)"))
    return both.select("node", "begins", "ends", "word_begins", "word_ends", (ends if take == "all" else F.col("raw")).alias("rest"))


def remove_repeated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with every byte of a repeated window taken out of ``text``.

    Bytes of a character that was cut in two are dropped with it.  A text that loses
    nothing stays as it is (null stays null); rows are never dropped, repeated rows stay
    repeated, and an empty table gives an empty one.
    """
    _, changes = repeated_spans(docs, text, key, **options)
    node, rest = free_name(docs, "n__"), free_name(docs, "r__")
    changes = changes.select(F.col("node").alias(node), F.col("rest").alias(rest))

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [b.decode("utf-8", "ignore") for b in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=[node, rest])

    changes = written(map_batches(changes, decode, f"{node} binary, {rest} string"), "suffix-rests")
    own = column_of(docs, text)
    joined = join_few(docs, F.unhex(F.sha2(F.col(f"`{own}`").cast("binary"), 256)), changes, node)
    return joined.select(*[F.when(F.col(node).isNull(), F.col(f"`{c}`")).otherwise(F.col(rest)).alias(c) if c == own else F.col(f"`{c}`") for c in docs.columns])


#: A passage of over 50 words that comes again is one, whatever its bytes.
PASSAGE_WORDS = 51


def op10_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes and runs, and the digest of what remains, for every document.

    Removal is by windows of 400 bytes.  ``n_passage_bytes`` counts the bytes of windows of 51
    words that come again, which may be shorter than 400 bytes; they stay in the text.
    """
    rows, changes = repeated_spans(docs, words=PASSAGE_WORDS, take="bytes")

    def covered(begins: str, ends: str):
        return F.aggregate(F.zip_with(begins, ends, lambda b, e: (e - b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    cut = changes.select("node", covered("begins", "ends").alias("removed"), F.size("begins").cast("long").alias("spans"), F.sha2("rest", 256).alias("sha"), covered("word_begins", "word_ends").alias("passages"))
    joined = rows.join(written(cut, "suffix-cut"), "node", "left")
    return joined.select(
        F.col("key").alias("doc_id"), "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", F.lower(F.hex("node"))).alias("kept_sha256"), F.coalesce("passages", F.lit(0)).cast("long").alias("n_passage_bytes"),
    )
