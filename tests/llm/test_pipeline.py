"""The corpus pipeline against its stages done by brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
from tidemark.llm.byte_bpe import byte_bpe
from tidemark.llm.lang_id import identify, train
from tidemark.llm.quality import fit_bands, quality_rules


def near_kept(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 3 else set(zip(w, w[1:], w[2:], strict=False))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in where[s])
        for s in sets[i]:
            where[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i for i in sets if find(i) == i}


def cut(texts, words=51, width=400):
    """Texts without the bytes of windows of so many words, or of so many bytes, that come again."""
    raw = [t.encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)] for b in raw]
    parts = [[b[x:y] for x, y in s] for b, s in zip(raw, spans, strict=True)]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    words_seen = Counter(tuple(p[i : i + words]) for p in parts for i in range(len(p) - words + 1))
    out = []
    for b, s, p in zip(raw, spans, parts, strict=True):
        mark = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                mark[i : i + width] = b"\1" * width
        for i in range(len(p) - words + 1):
            if words_seen[tuple(p[i : i + words])] > 1:
                mark[s[i][0] : s[i + words - 1][1]] = b"\1" * (s[i + words - 1][1] - s[i][0])
        out.append(bytes(x for x, m in zip(b, mark, strict=True) if not m).decode("utf-8", "ignore"))
    return out


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = quality_rules(docs, fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).filter("kept").select(docs.columns)
    named = identify(good, train(good)).filter("lang_pred <> 'und' and score >= 0.5")
    rows = sorted((r.doc_id, r.text) for r in named.select("doc_id", "text").collect())
    kept = near_kept(rows)
    rows = [r for r in rows if r[0] in kept]
    sizes = {i: len(byte_bpe().encode(t)) + 1 for (i, _), t in zip(rows, cut([t for _, t in rows]), strict=True)}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    total = Counter()
    for r in found:
        total[r.doc_id] += r.length
    assert dict(total) == sizes
    assert 0 < len(sizes) < docs.count()


def test_stages_return_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_take_what_comes(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, "b", None), (3, "one two three " * 40, "en", "c", 5), (4, "the word is not the same as the other word in this text of many words and the rest of it goes on for a while until there are more than fifty different words in it so that nobody can say it was short or that it repeats itself over and over again like bad pages on the web do", "en", "d", 9)]
    rows += [(*rows[-1][:3], "e", 9), (6, rows[-1][1] + " end", "en", "f", 9)]
    docs = spark.createDataFrame([(*r, "k", "r") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, reason string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert {(r.kept, r.reason) for r in out.collect()} == {("k", "r")}
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()) == [4, 4, 6]
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, sf_dir).collect()) == [3, 4, 4, 6]
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == [0, 1, 2, 3, 4, 4]
    assert corpus_pipeline.suffix_dedup(spark, docs, sf_dir).count() == len(rows)
    assert corpus_pipeline.packing(spark, docs, sf_dir).filter("piece = 0").count() == len(rows)
