"""Operator 2, SentencePiece encoding and decoding as a streaming Viterbi.

Of all segmentations of a prefix that end in a given piece only one can be part of the
encoding: the last piece must go with the piece before it as the merges would make
them.  The lattice therefore keeps one backpointer for each position, its last piece, and a
path survives only if it ends at the head or at a place, at most the longest piece behind
it, from which a piece may still go on; ``BpeAutomaton`` holds these windows as states.
Symbols are read ``SEGMENT`` at a time.  After each segment the surviving paths are walked
back until they meet on one boundary; the ids before it are committed and their
backpointers forgotten, so what is kept is the stretch from there to the head, inside
words of any length.  Ids don't depend on where segments end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_automaton import BpeAutomaton, backtrack, meeting
from tidemark.llm.common import free_name, in_arrow, others, public_vocabulary, text_slices, texts_of

MARK = "\u2581"
SEGMENT = 1 << 19  # symbols


class PieceCodec:
    """Encoder and decoder of a BPE model with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(self.pieces[i][3:5], 16)] = i
        plain = {p: i for i, p in enumerate(self.pieces) if not special[i] and not model.is_byte(i)}
        self.by_word = not any(MARK in p.lstrip(MARK) for p in plain)  # no piece goes on into the next word
        score = {p: model.get_score(i) for p, i in plain.items()}
        alphabet = sorted(p for p in plain if len(p) == 1)
        self.symbol = np.full(0x110000, -1, np.int32)
        for k, c in enumerate(alphabet):
            self.symbol[ord(c)] = k
        self.automaton = BpeAutomaton(plain, alphabet, alphabet, lambda a, b: -score[a + b] if a + b in score else None, max_states=150_000, track=True)
        self.lengths = np.array([max(1, len(p)) for p in self.pieces], np.int64)
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def encode(self, texts: list[str], segment: int = SEGMENT) -> list[np.ndarray]:
        """Ids of each text, as the sentencepiece library gives them."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        stops = np.cumsum([len(t) for t in marked])
        parts = list(self._stream("".join(marked), stops, segment))
        if not parts:
            return [np.zeros(0, np.int32) for _ in texts]
        ids, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        return np.split(ids, np.searchsorted(place, stops)[:-1])

    def _stream(self, joined: str, stops: np.ndarray, segment: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Committed ids and the place of each one's last symbol, segment by segment."""
        held, at, state = np.zeros(0, np.int32), np.zeros(0, np.int64), None
        for begin in range(0, len(joined), segment):
            # one symbol more, to see whether a word ends with the segment
            points = np.frombuffer(joined[begin : begin + segment + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            n = min(segment, len(joined) - begin)
            symbol = self.symbol[points]
            known = symbol >= 0
            ends = np.zeros(len(points), bool)
            ends[:-1] = ~known[1:]  # before an unknown character a word ends, too
            if self.by_word:
                mark = points == ord(MARK)
                ends[:-1] |= mark[1:] & ~mark[:-1]
            over = stops[np.searchsorted(stops, begin, "right") :]
            ends[over[over <= begin + n] - 1 - begin] = True
            symbol, known, ends = symbol[:n], known[:n], ends[:n]
            given, state = self.automaton.run(symbol[known], ends[known], state)
            last = np.r_[held, given]
            at = np.r_[at, begin + np.flatnonzero(known)]
            meet = meeting(last, state, self.lengths)
            stop = np.r_[np.zeros(len(held), bool), ends[known]][:meet]
            stop[-1:] = True
            ids, where = backtrack(last[:meet], stop, self.lengths)
            place = at[where]
            odd = np.flatnonzero(~known)
            if len(odd):  # byte fallback
                raw = [chr(points[i]).encode("utf-8", "surrogatepass") for i in odd.tolist()]
                more = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
                ids, place = np.r_[ids, more], np.r_[place, np.repeat(begin + odd, [len(x) for x in raw])]
                order = np.argsort(place, kind="stable")
                ids, place = ids[order], place[order]
            held, at = last[meet:], at[meet:]
            yield ids, place

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, marks as spaces, the first one dropped; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each Python worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _mapped(docs: DataFrame, column: str, keep: list[str] | None, names: list[str], kinds: list[pa.DataType], schema: str, fn) -> DataFrame:
    given = others(docs, names, keep)
    inner = free_name(docs, "t__")
    rows = docs.select(*[F.col(f"`{c}`") for c in given], F.col(f"`{column}`").alias(inner))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = fn(batch, inner)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*given, *names])

    return in_arrow(rows, run, fields + schema)


def encode_pieces(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str = "piece_bpe_32k.model", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` (null or empty: none) as an array; no shuffle.

    Columns named like the result, in any case, give way; repeated rows stay repeated, equal
    texts have equal ids, and an empty table gives an empty one.
    """
    path = public_vocabulary(vocabulary)

    def fn(batch, inner):
        found: list[np.ndarray] = []
        for begin, end in text_slices(batch, inner):
            found += codec(path).encode(texts_of(batch, inner, begin, end))
        return [found]

    return _mapped(docs, text, keep, [out], [pa.list_(pa.int32())], f"`{out}` array<int>", fn)


def decode_pieces(rows: DataFrame, ids: str = "ids", keep: list[str] | None = None, vocabulary: str = "piece_bpe_32k.model", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array of ids; a null array is the empty text; other columns as in ``encode_pieces``."""
    path = public_vocabulary(vocabulary)

    def fn(batch, inner):
        return [[codec(path).decode(np.array(x or [], np.int64)) for x in batch.column(inner).to_pylist()]]

    return _mapped(rows, ids, keep, [out], [pa.string()], f"`{out}` string", fn)


def op2_sentencepiece(docs: DataFrame) -> DataFrame:
    """Number and CRC-32 of each whole text's ids, and whether decoding gives the text back."""
    path = public_vocabulary("piece_bpe_32k.model")

    def fn(batch, inner):
        n, crc, same = [], [], []
        for begin, end in text_slices(batch, inner):
            texts = texts_of(batch, inner, begin, end)
            for text, ids in zip(texts, codec(path).encode(texts), strict=True):
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                same.append(codec(path).decode(ids) == text.replace(MARK, " "))
        return [n, crc, same]

    return _mapped(docs, "text", ["doc_id"], ["n_ids", "ids_crc32", "round_trip"], [pa.int64(), pa.int64(), pa.bool_()], "n_ids long, ids_crc32 long, round_trip boolean", fn)
