"""Token counts of a lower-casing word BPE (``</w>`` word ends) by finite-state transducers."""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np

from tidemark.llm.bpe_automaton import BpeAutomaton

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kinds[cp] = LETTER
        elif c == "N":
            kinds[cp] = NUMBER
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


class WordBpeCounter:
    """Counts as the tokenizers library gives them for a vocabulary of this kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        end = spec["model"]["end_of_word_suffix"]
        chars = byte_symbols()
        final = {c: chr(0xE000 + b) for b, c in enumerate(chars)}

        def own(piece: str) -> str:
            return piece[: -len(end) - 1] + final[piece[-len(end) - 1]] if piece.endswith(end) and len(piece) > len(end) else piece

        pieces = {own(p): i for p, i in spec["model"]["vocab"].items() if p not in self.specials}
        merges = {(own(m[0]), own(m[1])): r for r, m in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        self.automaton = BpeAutomaton(pieces, chars, [final[c] for c in chars], lambda a, b: merges.get((a, b)))
        self.kinds = char_classes()
        # code points that this Python doesn't know may be letters to the library
        self.unknown = np.array([unicodedata.category(chr(cp)) == "Cn" for cp in range(sys.maxunicode + 1)])

    def strange(self, text: str) -> bool:
        """Special strings and unassigned characters are left to the library."""
        if any(s in text for s in self.specials):
            return True
        return not text.isascii() and bool(self.unknown[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letter by letter, so never the final form
                text = text.replace("Σ", "σ")
        return text.lower()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without added special tokens."""
        odd = {i for i, t in enumerate(texts) if self.strange(t)}
        out = self._counts(["" if i in odd else self.normal(t) for i, t in enumerate(texts)])
        for i in odd:
            out[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return out

    def scan(self, joined: str):
        """Bytes without white space, the last byte of each word, and which bytes were kept."""
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        points = raw if len(raw) == len(joined) else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[points]
        start = np.empty(len(kind), bool)
        start[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == NUMBER
        quotes = np.flatnonzero((points == 39) & start)
        if len(quotes):  # 's 't 're 've 'm 'll 'd at a word's start
            padded = np.r_[points, [0, 0]]
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(quotes), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            for found, n in ((short, 2), (long, 3)):
                at = quotes[found]
                start[at + 1] = False
                at = at[at + n < len(start)] + n
                start[at] = True
        if len(raw) != len(points):
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            wide = np.zeros(len(raw), bool)
            wide[lead[start]] = True
            kept = np.repeat(kind != SPACE, np.diff(np.r_[lead, len(raw)]))
            start = wide
        else:
            kept = kind != SPACE
        begins = start[kept]
        ends = np.empty(len(begins), bool)
        ends[:-1] = begins[1:]
        ends[-1:] = True
        return raw[kept], ends, kept

    def _counts(self, texts: list[str]) -> list[int]:
        sizes = [len(t.encode("utf-8", "surrogatepass")) if not t.isascii() else len(t) for t in texts]
        symbols, ends, kept = self.scan("\n".join(texts))
        added, _ = self.automaton.run(symbols, ends)
        total = np.r_[0, np.cumsum(added, dtype=np.int64)]
        place = np.r_[0, np.cumsum(kept, dtype=np.int64)]
        stop = np.cumsum(np.array(sizes, np.int64) + 1) - 1
        begin = np.r_[0, stop[:-1] + 1][: len(stop)]
        return (total[place[stop]] - total[place[begin]]).tolist()
