"""Ids of a byte-level BPE vocabulary, as the tokenizers library gives them."""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np

from tidemark.llm.common import public_vocabulary

#: Characters on which both libraries' Unicode tables agree for certain; other texts take the slower library.
_PLAIN = re.compile("[\\x00-\\u024f\\u2000-\\u206f\\u20a0-\\u20bf]*\\Z")


class ByteBpe:
    """``encode`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    The same merges are stored twice among the public vocabularies; the rank file's
    encoder is five times as fast and gives the same ids.  Texts beyond the Latin blocks
    go through the tokenizers library.  Special strings inside a text become their id,
    which is that library's default.
    """

    def __init__(self, name: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken"):
        import public_tokenizers
        import tiktoken

        self.path = public_vocabulary(name)
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([len(spec["model"]["vocab"]), *(i + 1 for i in self.specials.values())])
        del spec
        with open(public_vocabulary(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.cut = re.compile("|".join(f"({re.escape(s)})" for s in self.specials))

    @functools.cached_property
    def library(self):
        """Loaded when a text needs it: it takes more memory than all else here."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def encode(self, text: str) -> np.ndarray:
        if not _PLAIN.match(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.cut.search(text):
            ids: list[int] = []
            for part in self.cut.split(text):
                if part in self.specials:
                    ids.append(self.specials[part])
                elif part:
                    ids += self.fast.encode_ordinary(part)
            return np.array(ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(name: str = "byte_bpe_50k.json") -> ByteBpe:
    """One encoder for each Python worker."""
    if name not in _loaded:
        _loaded[name] = ByteBpe(name)
    return _loaded[name]
