"""Operator 7, near-duplicate documents by HyperMinHash.

A document's set holds the hashes of its distinct word shingles.  A bucket keeps the
least of the set's values under one of ``BANDS * ROWS`` hash functions, compressed to
its leading-zero count (6 bits) and the 10 mantissa bits after it.  Documents with an
equal band of registers meet; two documents at the threshold of 0.85 do with probability
1 - (1 - 0.85**6)**30 > 0.999999.  Of those that meet, the register estimate, corrected
for accidental collisions, leaves out pairs that are ``SLACK`` below the threshold, over
seven deviations (a pair at the threshold is lost with probability below 10**-12).  What
it keeps forms candidate groups, whose pairs are confirmed on full sets.

Both steps connect the members of many groups (bands, then candidate groups) in the
same way: every member is compared with its group's first one, in time linear in the
group.  Only members that are not like the first one, if there are any, then meet the
whole group, in blocks of bounded size: so many blocks of these by so many of all.  A
task gives back links that connect what is alike, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, KeyBitmap, bytes_of, connected_components, filter_lists, in_arrow, map_batches, mix, prefix_hashes, probable, span_hash, text_slices, written

BANDS, ROWS = 30, 6
MANTISSA = 10
BLOCK_SHINGLES = 2_000_000
BLOCK_MEMBERS = 4096  # of a band
SLACK = 0.2  # a pair whose estimate is this far below the threshold (over seven deviations) is left out
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xA0761D6478BD642F))
_spaces = np.zeros(256, bool)
_spaces[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Hash, document, begin and end of every word ``[^\\x20\\x09-\\x0D]+`` of concatenated texts."""
    gap = _spaces[data]
    if lower:
        data = _lower[data]
    begin = np.empty(len(data), bool)
    begin[:1] = True
    begin[1:] = gap[:-1]
    edge = offsets[offsets < len(data)]
    begin[edge] = True
    ends = np.empty(len(data), bool)
    ends[-1:] = True
    ends[:-1] = gap[1:]
    ends[edge[edge > 0] - 1] = True
    first, last = np.flatnonzero(begin & ~gap), np.flatnonzero(ends & ~gap) + 1
    hashes = span_hash(prefix_hashes(data), first, last)
    return hashes, np.searchsorted(offsets, first, "right") - 1, first, last


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words has one shingle, one without words none."""
    hashes, doc, _, _ = words(data, offsets)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    stops = np.cumsum(n)
    rolled = np.zeros(len(hashes), U64)
    for k in range(size):
        rolled[: len(hashes) - k] += hashes[k:] * FACTORS[k]
    rolled = mix(rolled)
    out = []
    for count, stop in zip(n.tolist(), stops.tolist(), strict=True):
        if count >= size:
            out.append(np.unique(rolled[stop - count : stop - size + 1]))
        elif count:
            short = hashes[stop - count : stop]
            out.append(mix(np.array([(short * FACTORS[: len(short)]).sum(dtype=U64) + U64(count)], U64)))
        else:
            out.append(short_empty)
    return out


short_empty = np.zeros(0, U64)


def registers(values: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least value in each bucket."""
    least = np.full(len(FACTORS), np.iinfo(U64).max, U64)
    for k in range(0, len(values), 512):
        part = (values[k : k + 512, None] ^ SEEDS) * FACTORS
        np.minimum(least, part.min(axis=0), out=least)
    least |= U64(1)
    zeros = 64 - np.frexp((least & ~U64(0x7FF) | U64(1)).astype(np.float64))[1]
    after = (least << np.minimum(zeros + 1, 63).astype(U64)) >> U64(64 - MANTISSA)
    return (zeros.astype(np.uint16) << MANTISSA) | after.astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of registers, for one document or a row each."""
    rows = regs.reshape(*regs.shape[:-1], BANDS, ROWS).astype(U64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), rows.shape[:-1])
    for k in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + rows[..., k])
    return key.view(np.int64)


def zeros_shares(sizes: np.ndarray) -> np.ndarray:
    """Probability that the least of so many values has 0, 1, ... 63 leading zeros; a row for each size."""
    level = np.arange(64)
    n = np.asarray(sizes, np.float64)[:, None]
    return np.power(1 - np.exp2(-(level + 1.0)), n) - np.where(level == 0, 0.0, np.power(1 - np.exp2(-np.maximum(level, 1.0)), n))


def estimate(regs: np.ndarray, others: np.ndarray, share: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, less those that agree by accident (``zeros_shares`` of both sides)."""
    accident = shares @ share / (1 << MANTISSA)
    return np.clip(((others == regs).mean(axis=1) - accident) / (1 - accident), 0, 1)


def compatible(regs: np.ndarray, sizes: np.ndarray, shares: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` whose sizes and register estimate allow them to be alike to row ``i``."""
    near = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
    return near[estimate(regs[i], regs[near], shares[i], shares[near]) >= percent / 100 - SLACK] if len(near) else near


def linked(regs: np.ndarray, sizes: np.ndarray, percent: int, sets: list[np.ndarray] | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """Component number of every row, when rows of at least ``percent`` similarity are linked: by full sets, or by the estimate without them.

    ``label`` holds components that are known.  Rows are taken as centres and compared with
    all rows outside their component; as soon as every row outside the largest component
    has been a centre, all links between components have been looked at.
    """
    n = len(sizes)
    label = np.arange(n) if label is None else label.copy()
    if sets is not None:
        starts = np.r_[0, np.cumsum(sizes)]
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(codes.max() + 1, np.int32)
    tried = np.zeros(n, bool)
    shares = zeros_shares(sizes)
    while True:
        largest = int(np.flatnonzero(label == np.bincount(label).argmax())[0])  # a member of it
        rest = np.flatnonzero(~tried & (label != label[largest]))
        if not len(rest):
            return label
        for i in rest[:256].tolist():
            if label[i] == label[largest]:
                continue
            tried[i] = True
            near = compatible(regs, sizes, shares, i, np.flatnonzero(label != label[i]), percent)
            if sets is not None and len(near):
                mine = codes[starts[i] : starts[i + 1]]
                mark[mine] = 1
                if 4 * sizes[near].sum() >= len(codes):
                    both = np.add.reduceat(mark[codes], starts[:-1])[near]
                else:
                    both = np.array([mark[codes[starts[j] : starts[j + 1]]].sum() for j in near.tolist()])
                mark[mine] = 0
                near = near[100 * both >= percent * (sizes[i] + sizes[near] - both)]
            if len(near):
                joined = np.unique(np.r_[label[near], label[i]])
                label[np.isin(label, joined)] = joined[0]


def _columns(batch: pa.RecordBatch, full: bool, prefix: str = "") -> tuple[np.ndarray, np.ndarray, list[np.ndarray] | None]:
    """Registers, sizes and, if asked for, sets of a batch's rows."""
    regs = np.stack([np.frombuffer(r, np.uint16) for r in batch.column(f"{prefix}regs").to_pylist()])
    sets = [np.frombuffer(f, U64) for f in batch.column(f"{prefix}found").to_pylist()] if full else None
    return regs, batch.column(f"{prefix}n").to_numpy().astype(np.int64), sets


def group_links(groups: DataFrame, rows_of, percent: int, block: int, full: bool, name: str) -> DataFrame:
    """Links (a, b) between nodes that connect the members of every group just as their alike pairs do.

    ``groups``: a written table (grp, node, weight).  ``rows_of`` gives the same rows with n
    and registers, and full sets if ``full``, for any such table with more columns.
    """
    first = groups.groupBy("grp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size"))
    first = written(first.filter("size > 1"), f"{name}-first")
    data = ["n", "regs", *(["found"] if full else [])]
    heads = rows_of(groups.join(first, "grp").filter("node = head").select("grp", "node", "size"), ["grp", "size"])
    heads = written(heads.select("grp", "size", F.col("node").alias("head"), *[F.col(c).alias(f"head_{c}") for c in data]), f"{name}-heads")
    node = groups.schema["node"].dataType.simpleString()
    grp = groups.schema["grp"].dataType.simpleString()
    members = rows_of(groups.join(first, "grp").filter("node <> head").select("grp", "node", "weight"), ["grp", "weight"])

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        regs, n, sets = _columns(batch, full)
        others, m, others_sets = _columns(batch, full, "head_")
        accident = (zeros_shares(n) * zeros_shares(m)).sum(axis=1) / (1 << MANTISSA)
        guess = ((regs == others).mean(axis=1) - accident) / (1 - accident)
        hit = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.clip(guess, 0, 1) >= percent / 100 - SLACK)
        if full:
            for i in np.flatnonzero(hit).tolist():
                both = len(np.intersect1d(sets[i], others_sets[i], assume_unique=True))
                hit[i] = 100 * both >= percent * (n[i] + m[i] - both)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "node", "head", "weight", "size")), pa.array(hit)], names=["grp", "node", "head", "weight", "size", "hit"])

    schema = f"grp {grp}, node {node}, head {node}, weight long, size long, hit boolean"
    compared = written(map_batches(members.join(heads, "grp"), compare, schema), f"{name}-compared")
    known = compared.filter("hit").select(F.col("head").alias("a"), F.col("node").alias("b"))
    # members unlike the first one meet the whole group; in a group of two there is nobody else
    rest = compared.filter("size > 2").groupBy("grp", "head").agg(F.sum("weight").alias("all"), F.coalesce(F.sum(F.when(~F.col("hit"), F.col("weight"))), F.lit(0)).alias("odd"))
    rest = rest.filter("odd > 0").select("grp", "head", F.ceil(F.col("all") / block).cast("int").alias("blocks"), F.ceil(F.col("odd") / block).cast("int").alias("odds"))
    rest = written(rest, f"{name}-rest")
    if rest.isEmpty():
        return written(known, f"{name}-links")
    again = compared.join(rest.select("grp", "blocks", "odds"), "grp").select("grp", "node", "hit", "blocks", "odds")
    again = again.unionByName(rest.select("grp", F.col("head").alias("node"), F.lit(True).alias("hit"), "blocks", "odds"))
    every = rows_of(again, ["grp", "hit", "blocks", "odds"])
    place, odd = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("odds")).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    as_any = F.transform(F.sequence(F.lit(0), F.col("odds") - 1), lambda i: pair(i, place))
    as_odd = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: pair(odd, j))
    dealt = every.withColumn("at", F.explode(F.when(F.col("hit"), as_any).otherwise(F.array_union(as_any, as_odd)))).select("grp", "at.i", "at.j", "node", "hit", *data)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        at = None

        def forest() -> pa.RecordBatch:
            names = sorted(held)
            own = [held[x] for x in names]
            label = np.arange(len(names))
            alike = np.array([r[0] for r in own])
            if alike.any():  # all of these are linked with the first
                label[alike] = np.flatnonzero(alike)[0]
            label = linked(np.stack([np.frombuffer(r[2], np.uint16) for r in own]), np.array([r[1] for r in own], np.int64), percent, [np.frombuffer(r[3], U64) for r in own] if full else None, label)
            # one link to those that are linked with the first anyway is enough
            one = int(np.flatnonzero(alike)[0]) if alike.any() else -1
            pairs = [(names[k], names[i]) for i, k in enumerate(_first_of(label).tolist()) if k != i and (not alike[i] or i == one)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kinds[0]), pa.array([p[1] for p in pairs], kinds[0])], names=["a", "b"])

        for batch in batches:
            kinds = [batch.schema.field("node").type]
            for g, i, j, x, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, i, j) != at:
                    if len(held) > 1:
                        yield forest()
                    at, held = (g, i, j), {}
                held[x] = row
        if len(held) > 1:
            yield forest()

    grouped = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return written(known.union(in_arrow(grouped, resolve, f"a {node}, b {node}")), f"{name}-links")


def _first_of(label: np.ndarray) -> np.ndarray:
    """Place of the first row with each row's label."""
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    return first[back]


def near_dups(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 85, shingle: int = 3, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(key, n_shingles, component) for every row of ``docs``.

    ``component`` is the least key among the rows linked with it, directly or through
    others; rows with equal sets are linked.  A row without words has the empty set
    and is linked with nothing: its component is its own key.  Null keys count as
    absent in a component's least key.  Repeated rows and keys stay rows of their own.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
    kind = source.schema["key"].dataType.simpleString()

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, nodes, regs = [], [], []
        for begin, end in text_slices(batch, "t"):
            for s in shingle_sets(*bytes_of(batch, "t", begin, end), shingle):
                sizes.append(len(s))
                nodes.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(regs, pa.binary())], names=["key", "n_shingles", "node", "regs"])

    rows = written(map_batches(source, sketch, f"key {kind}, n_shingles long, node binary, regs binary"), "near-sketches")
    # equal sets are one node
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.max("n_shingles").alias("n"), F.first("regs").alias("regs"))
    nodes = written(nodes, "near-nodes")

    def bands_of(batch: pa.RecordBatch, shared: KeyBitmap | None) -> pa.RecordBatch:
        regs = batch.column(1).to_pylist()
        keys = band_keys(np.frombuffer(b"".join(regs), np.uint16).reshape(-1, BANDS * ROWS)).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(regs) + 1, dtype=np.int32) * BANDS), pa.array(keys))
        return pa.RecordBatch.from_arrays([batch.column(0), *([lists] if shared is None else filter_lists(lists, shared.has(keys)))], names=["node", "bands"])

    def banded(shared: KeyBitmap | None = None) -> DataFrame:
        return map_batches(nodes.select("node", "regs"), lambda batch: bands_of(batch, shared), "node binary, bands array<long>").select("node", F.explode("bands").alias("grp"))

    h = [F.xxhash64("node", F.lit(i)) for i in (1, 2)]
    shared = banded().select("grp", h[0].alias("x")).groupBy("grp").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    shared = written(shared.filter("lo <> hi").select("grp"), "near-bands")
    met = written(banded(KeyBitmap(shared, "grp")).join(shared, "grp", "left_semi"), "near-met")
    # of bands with the same nodes one is enough
    alike = met.select("grp", h[0].alias("x"), h[1].alias("y")).groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("x").alias("lo"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"))
    alike = alike.groupBy("size", "lo", "x", "y").agg(F.min("grp").alias("grp")).select("grp")
    met = written(met.join(alike, "grp", "left_semi").select("grp", "node", F.lit(1).cast("long").alias("weight")), "near-met")

    def with_registers(groups: DataFrame, keep: list[str]) -> DataFrame:
        few = written(groups, "near-some")
        names = written(few.select("node").distinct(), "near-names")
        return few.join(probable(nodes.select("node", "n", "regs"), F.col("node"), names, "node"), "node").select(*keep, "node", "n", "regs")

    likely = group_links(met, with_registers, percent, BLOCK_MEMBERS, False, "near-likely")
    groups = connected_components(likely, "near-groups").withColumnRenamed("comp", "grp")
    groups = written(groups.join(nodes.select("node", "key", "n"), "node").select("grp", "node", "key", F.col("n").alias("weight")), "near-candidates")

    def with_sets(some: DataFrame, keep: list[str]) -> DataFrame:
        """Rows of candidate groups with their sets, made again from the text of the node's first key."""
        few = written(some.join(groups.select("node", F.col("key").alias("first")), "node").select(*keep, "node", "first"), "near-wanted")

        def sets(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            sizes, found, regs, node = [], [], [], []
            for begin, end in text_slices(batch, "t"):
                for s in shingle_sets(*bytes_of(batch, "t", begin, end), shingle):
                    sizes.append(len(s))
                    found.append(s.tobytes())
                    regs.append(registers(s).tobytes())
                    node.append(hashlib.blake2b(s, digest_size=16).digest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(regs, pa.binary()), pa.array(node, pa.binary())], names=["key", "n", "found", "regs", "now"]) if node else None

        made = map_batches(probable(source, F.col("key"), few, "first"), sets, f"key {kind}, n long, found binary, regs binary, now binary")
        return made.join(few, (F.col("now") == F.col("node")) & F.col("key").eqNullSafe(F.col("first"))).select(*keep, "node", "n", "regs", "found")

    links = group_links(groups.select("grp", "node", "weight"), with_sets, percent, block, True, "near-sure")
    roots = connected_components(links, "near-components")
    known = nodes.select("node", "key").join(roots, "node", "left").select("node", "key", F.coalesce("comp", "node").alias("comp"))
    known = written(known, "near-known")
    least = written(known.groupBy("comp").agg(F.min("key").alias("component")), "near-least")
    final = written(known.join(least, "comp").select("node", "component"), "near-final")
    out = rows.select("key", "n_shingles", "node").join(final, "node", "left")
    return out.select("key", "n_shingles", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))


def op7_near_dedup(docs: DataFrame) -> DataFrame:
    """Size of its set, component and whether it stays, for every document."""
    found = near_dups(docs)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))
