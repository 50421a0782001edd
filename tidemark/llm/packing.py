"""Operator 4, best-fit packing with exact complements.

Documents become pieces of at most ``capacity`` tokens.  Only how many pieces there
are of each length matters to a packing, so it is planned on at most ``capacity``
counts: sums of one, two and three lengths are indexed, combinations that fill a
sequence exactly are consumed as often as the counts allow, and what is left is packed
by best fit.  Every step of the plan uses up at least one length, so the plan has at
most a few thousand lines, whatever the number of documents.  Pieces find their place
by their rank among the pieces of their length: the rank inside the partition that cut
them plus the number in earlier partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import byte_bpe
from tidemark.llm.common import in_arrow, text_slices, texts_of, written

END_ID = 2


class SumIndex:
    """Sums of one, two and three lengths, of those that occur: gap -> the combinations that fill it exactly.

    Singles and pairs are held by their sums; a triple's sum is found as its longest length
    and the pairs that are indexed under the rest.
    """

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths = np.sort(lengths)[::-1]  # longest first
        self.single = np.zeros(capacity + 1, bool)
        self.single[lengths] = True
        a, b = np.meshgrid(self.lengths, self.lengths, indexing="ij")
        keep = (a >= b) & (a + b <= capacity)
        a, b = a[keep], b[keep]
        order = np.lexsort((-a, a + b))  # by sum, the most unequal pair last
        self.long, self.short = a[order][::-1], b[order][::-1]
        total = (a + b)[order][::-1]
        self.first = len(total) - np.searchsorted(total[::-1], np.arange(capacity + 1), "right")
        self.end = len(total) - np.searchsorted(total[::-1], np.arange(capacity + 1), "left")

    def pairs(self, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Longer and shorter length of every pair with this sum, from equal to far apart."""
        at = slice(self.first[total], self.end[total])
        return self.long[at], self.short[at]

    def filling(self, gap: int, size: int, have: np.ndarray, most: int):
        """Available combinations of ``size`` lengths of at most ``most`` that sum to ``gap``; ``have`` may change meanwhile."""
        if size == 1:
            if gap <= most and self.single[gap] and have[gap]:
                yield (gap,)
        elif size == 2:
            long, short = self.pairs(gap)
            fits = (long <= most) & (have[long] > 0) & (have[short] > 0)
            yield from zip(long[fits].tolist(), short[fits].tolist(), strict=True)
        else:
            for x in self.lengths[(self.lengths <= min(most, gap - 2)) & (3 * self.lengths >= gap)].tolist():
                if have[x]:
                    yield from ((x, *p) for p in self.filling(gap - x, 2, have, x))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, longest first) and how many sequences have each.

    Exact combinations of short lengths can use up what would have filled the gaps of
    long ones, so the index is tried for combinations that hold a length of at least
    some share of the capacity, for a few shares; the plan with the fewest sequences wins.
    """
    half, most = capacity // 2, capacity * 2 // 3
    shares = [(0, 0, capacity), (0, 0, 0), (0, capacity // 3, capacity), (0, capacity // 3, capacity // 3), (0, half, capacity), (0, half, half), (half, most, capacity), (half, most, most), (half, capacity, capacity)]
    index = SumIndex(np.array(sorted(counts), np.int64), capacity)
    tries = [_plan(counts, capacity, index, s) for s in shares]
    return min(tries, key=lambda patterns: sum(times for _, times in patterns))


def _plan(counts: dict[int, int], capacity: int, index: SumIndex, shares: tuple[int, int, int]) -> list[tuple[tuple[int, ...], int]]:
    """``shares``: how long a length must be for its gap to be filled by one, two and three others."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] += n
    if have[0]:
        raise ValueError("a piece has at least one token")
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]):
        """Consume a combination as often as the counts allow."""
        need = np.bincount(lengths, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((have[used] // need[used]).min())
        if times:
            have[used] -= times * need[used]
            out.append((lengths, times))

    take((capacity,))
    for longest in range(capacity - 1, 0, -1):
        gap = capacity - longest
        for size, least in enumerate(shares, 1):
            if longest >= least and have[longest]:
                for others in index.filling(gap, size, have, longest):
                    take((longest, *others))
                    if not have[longest]:
                        break
        while have[longest] and longest >= shares[0]:  # best fit: each gap takes the longest length that fits
            lengths, left, room = [longest], have.copy(), gap
            left[longest] -= 1
            while room and len(fits := np.flatnonzero(left[: room + 1])):
                lengths.append(int(fits[-1]))
                left[fits[-1]] -= 1
                room -= int(fits[-1])
            take(tuple(lengths))
    while have.any():
        lengths, left, room = [], have.copy(), capacity
        while room and len(fits := np.flatnonzero(left[: room + 1])):
            lengths.append(int(fits[-1]))
            left[fits[-1]] -= 1
            room -= int(fits[-1])
        take(tuple(lengths))
    return out


def plan_lines(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, copies per sequence, offset of the first copy) for each length in each pattern."""
    ranks: dict[int, int] = {}
    lines, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            copies = lengths.count(length)
            lines.append((length, ranks.get(length, 0), copies * times, sequence, copies, offset))
            ranks[length] = ranks.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return lines


def pieces(docs: DataFrame, capacity: int = 1024, text: str = "text", key: str = "doc_id", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids and end id: key, piece, start, length, ids_crc32, and part and rank for packing.

    Only documents of more than ``capacity`` tokens are cut; their first piece is the
    short one.  A null or empty text is its end id; null and repeated keys and repeated rows
    stay rows of their own; an empty table gives an empty one.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
    kind = source.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, bpe = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), byte_bpe()
        for batch in batches:
            for begin, end in text_slices(batch, "t"):
                rows: list[tuple] = []
                for i, text in enumerate(texts_of(batch, "t", begin, end), begin):
                    ids = np.append(bpe.encode(text), np.uint32(end_id)).astype("<u4")
                    n = -(-len(ids) // capacity)
                    start = 0
                    for piece in range(n):
                        stop = len(ids) - (n - 1 - piece) * capacity
                        own = ids[start:stop].tobytes()
                        rows.append((i, piece, start, stop - start, zlib.crc32(own), int(seen[stop - start]), own if with_ids else None))
                        seen[stop - start] += 1
                        start = stop
                at, piece, start, length, crc, rank, own = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64())]
                names = ["key", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    columns.append(pa.array(own, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = ", ids binary" if with_ids else ""
    # the table fixes the parts and ranks: what reads it sees the same ones, whatever is recomputed
    return written(in_arrow(source, cut, f"key {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long{extra}"), "pack-pieces")


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """``cut`` with sequence_id and offset: every sequence is gapless from 0 and at most ``capacity`` long."""
    spark = cut.sparkSession
    sizes = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    base = written(sizes.withColumn("before", before), "pack-bases")
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    lines = plan_lines(plan(counts, capacity))
    lines = spark.createDataFrame(lines, "length long, first long, ranks long, sequence long, copies long, place long")
    placed = cut.join(base.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the plan's size is bounded by the capacity, so it goes to every executor
    placed = placed.join(F.broadcast(lines.withColumnRenamed("length", "size")), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks")))
    turn = F.col("rank") - F.col("first")
    placed = placed.withColumns({"sequence_id": F.col("sequence") + F.floor(turn / F.col("copies")), "offset": F.col("place") + F.pmod(turn, F.col("copies")) * F.col("length")})
    return placed.drop("part", "rank", "before", "size", "first", "ranks", "sequence", "copies", "place")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """Ids of every sequence (little-endian 32-bit), from pieces made ``with_ids``; a sequence has at most its capacity of pieces."""
    one = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), one.alias("parts")).select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op4_best_fit_packing(docs: DataFrame) -> DataFrame:
    """Pieces of at most 1024 tokens of every document, with their sequence and place in it."""
    placed = pack(pieces(docs))
    return placed.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
