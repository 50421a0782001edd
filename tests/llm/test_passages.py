"""Repeated passages of 51 words in the pipeline's suffix-dedup stage."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tidemark.llm.suffix_dedup import remove_repeated


def cut(texts, words=51, width=400):
    raw = [t.encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)] for b in raw]
    parts = [[b[x:y] for x, y in s] for b, s in zip(raw, spans, strict=True)]
    seen = Counter(tuple(p[i : i + words]) for p in parts for i in range(len(p) - words + 1))
    bytes_seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b, s, p in zip(raw, spans, parts, strict=True):
        mark = bytearray(len(b))
        for i in range(len(p) - words + 1):
            if seen[tuple(p[i : i + words])] > 1:
                lo, hi = s[i][0], s[i + words - 1][1]
                mark[lo:hi] = b"\1" * (hi - lo)
        for i in range(len(b) - width + 1):
            if bytes_seen[b[i : i + width]] > 1:
                mark[i : i + width] = b"\1" * width
        out.append(bytes(x for x, m in zip(b, mark, strict=True) if not m).decode("utf-8", "ignore"))
    return out


def some_words(rng, n, least=2, most=7):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé漢", k=rng.randint(least, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)

    def around(passage, gap=" "):
        return " ".join(some_words(rng, rng.randint(0, 90))) + " " + gap.join(passage) + " " + " ".join(some_words(rng, rng.randint(1, 90)))

    out = []
    for n, most in ((50, 7), (51, 2), (51, 4), (51, 7), (52, 5), (60, 5), (120, 7), (40, 30)):  # words, letters in a word at most
        passage = some_words(rng, n, 1, most)
        out += [around(passage), around(passage), around(passage, "\n\t ")]
    long = "".join(rng.choices("漢字仮名交文", k=150))  # 450 bytes without a space
    out += [long + " x", "y " + long, "one two three " * 40, "", " \n", "x y " * 25, " ".join(some_words(rng, 51))]
    return out + out[-1:]


@pytest.mark.parametrize("block", [1024, 2])
def test_windows_of_words_and_bytes(spark, texts, block):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in remove_repeated(docs, words=51, block=block).collect()}
    assert [found[i] for i in range(len(texts))] == cut(texts)


def test_stage_takes_out_short_bytes(spark, sf_dir, texts):
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in corpus_pipeline.suffix_dedup(spark, docs, sf_dir).collect()}
    assert [found[i].text for i in range(len(texts))] == cut(texts)
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert all(found[i].text == texts[i] for i in range(3))  # 50 words are not over 50


def test_stage_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    found = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, sf_dir).collect()}
    expected = dict(zip([i for i, _ in rows], cut([t for _, t in rows]), strict=True))
    assert found == expected
    bytes_only = dict(zip([i for i, _ in rows], cut([t for _, t in rows], words=10**9), strict=True))
    assert expected != bytes_only
