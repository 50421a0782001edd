"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from tidemark.llm import common, entry
from tidemark.llm.fingerprints import compare_with_next, fingerprints
from tidemark.llm.lang_id import identify, train
from tidemark.llm.near_dup import near_dups
from tidemark.llm.packing import pack, packed_sequences, pieces
from tidemark.llm.pieces import decode_pieces, encode_pieces
from tidemark.llm.quality import quality_rules
from tidemark.llm.suffix_dedup import remove_repeated
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_store import read_keys, write_store
from tidemark.llm.url_rules import mine_rules, url_filter

LONG = "the long text goes on and on with many words " * 6000
ROWS = [
    (None, None, None, "a"),
    (1, None, "en", "b"),
    (2, "", "en", None),
    (3, " \n\t ", "fr", "d"),
    (4, "Hello, hello world!", "en", "e"),
    (4, "Hello, hello world!", "en", "e"),
    (5, "<|endoftext|> inside <|startoftext|>", "de", "f"),
    (6, "漢字かな交じり文 \U0001f600 é", None, "g"),
    (7, LONG, "en", "h"),
    (8, LONG, "en", "i"),
    (None, "no key", "fr", "j"),
    (9, "x" * 5000, "es", "k"),
]
CLASHING = ["t", "key", "node", "t__", "v__", "n_tokens", "ids", "score", "kept", "rank", "part", "h", "b", "e", "n__", "r__", "band__", "length", "n_words", "script", "reason", "lang_pred", "decoded"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["z"] * len(CLASHING)) for r in ROWS], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)).coalesce(1)


def texts():
    return [r[1] or "" for r in ROWS]


def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = token_counts(docs)
    assert set(out.columns) == set(docs.columns)
    assert [r.n_tokens for r in out.collect()] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts()]
    assert token_counts(docs.limit(0)).count() == 0


def test_pieces(spark, docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = decode_pieces(encode_pieces(docs))
    rows = out.collect()
    assert [list(r.ids) for r in rows] == [sp.encode(x) for x in texts()]
    assert [r.decoded for r in rows] == texts()
    assert encode_pieces(docs.limit(0)).count() == 0


def test_quality(spark, docs):
    rows = quality_rules(docs, {"en": (0.1, 9.0, 0.1, 9.0, 0.9, 0.1)}).collect()
    assert [r.n_words for r in rows] == [len(x.encode().split()) for x in texts()]
    assert all(not r.kept for r in rows if r.n_words < 50)
    assert quality_rules(docs.drop("lang")).count() == len(ROWS)
    assert quality_rules(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    cut = pieces(docs, capacity=256, with_ids=True)
    placed = pack(cut, 256)
    rows = placed.collect()
    by_sequence: dict[int, list] = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append(r)
    ids = {r.sequence_id: r.ids for r in packed_sequences(placed).collect()}
    for s, parts in by_sequence.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        assert ids[s] == b"".join(r.ids for r in sorted(parts, key=lambda r: r.offset))
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert pack(pieces(docs.limit(0))).count() == 0


def test_language(spark, docs):
    model = train(docs)
    out = identify(docs, model).collect()
    assert [r.lang_pred == "und" for r in out] == [not any(c.isalpha() for c in x) for x in texts()]
    assert all(0 <= r.score <= 1 for r in out)
    nothing = train(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0


def test_near_dups(spark, docs):
    rows = near_dups(docs).collect()
    assert len(rows) == len(ROWS)
    found = sorted((r.key, r.component) for r in rows if r.key is not None)
    assert found == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7), (9, 9)]
    assert near_dups(docs.limit(0)).count() == 0


def test_token_store(spark, docs):
    from tidemark.llm.byte_bpe import byte_bpe

    store = write_store(docs, common.work_path(spark, "test-store"), shard_tokens=100)
    rows = read_keys(spark, store, docs.select("doc_id")).orderBy("start").collect()
    own = [(r.key is not None, r.key or 0) for r in rows]
    assert own == sorted(own) and len(rows) == len(ROWS)
    left, at = [(r[0], r[1] or "") for r in ROWS], 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        for k, t in left:
            ids = np.array([*byte_bpe().library.encode(t, add_special_tokens=False).ids, 0], "<u4")
            if (k, len(ids), zlib.crc32(ids.tobytes())) == (r.key, r.n_tokens, r.ids_crc32):
                left.remove((k, t))
                break
        else:
            raise AssertionError(r)
    assert not left
    assert store.get(6) is not None and store.get(4) is not None
    assert store.get(99) is None and store.get(-5) is None
    assert read_keys(spark, store, spark.createDataFrame([(6,), (99,), (6,)], "k long")).count() == 1
    empty = docs.limit(0)
    assert read_keys(spark, write_store(empty, common.work_path(spark, "test-store")), empty.select("doc_id")).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        write_store(docs, "x", key="text")


def test_token_store_of_many_shards(spark):
    from tidemark.llm.byte_bpe import byte_bpe

    rng = np.random.default_rng(6)
    rows = [(int(k), f"text {i} " * int(rng.integers(1, 9))) for i, k in enumerate(rng.integers(-500, 500, 2500))]
    rows += [(3, f"hot {i}") for i in range(1200)] + [(None, "no key"), (None, None), (7, ""), (2**62, "far"), (-(2**62), "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    store = write_store(docs, common.work_path(spark, "test-store"), shard_tokens=20, bucket_keys=50)
    assert store.manifest.count() > 1000 and store.buckets > 10
    out = sorted(read_keys(spark, store, docs.select("doc_id")).collect(), key=lambda r: r.start)
    assert [r.start for r in out] == np.r_[0, np.cumsum([r.n_tokens for r in out])[:-1]].tolist()
    own = [(r.key is not None, r.key or 0) for r in out]
    assert own == sorted(own)
    assert sorted((k, n) for (_, k), n in zip(own, (r.n_tokens for r in out), strict=True)) == sorted((k or 0, len(byte_bpe().encode(t or "")) + 1) for k, t in rows)
    ids = store.get(2**62)
    assert byte_bpe().library.decode(ids.tolist()[:-1]) == "far" and store.get(1000) is None


def test_fingerprints(spark, docs):
    rows = fingerprints(docs).collect()
    same = {}
    for r, t in zip(rows, texts(), strict=True):
        assert same.setdefault(t, r.fingerprint) == r.fingerprint
    out = compare_with_next(docs).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert compare_with_next(docs.limit(0)).count() == 0


def test_remove_repeated(spark, docs):
    out = {(r.doc_id, r.source): r.text for r in remove_repeated(docs).collect()}
    assert out[7, "h"] == out[8, "i"] == "" and out[9, "k"] == "" and out[1, "b"] is None
    assert out[4, "e"] == "Hello, hello world!"
    assert remove_repeated(docs).columns == docs.columns
    assert remove_repeated(docs.limit(0)).count() == 0


def test_names_clash_in_any_case(spark, docs):
    """A column that differs from a result's name in case only gives way; others stay."""
    odd = spark.createDataFrame([(1, "some words of a text", "en", 5, "x")], "doc_id long, text string, Lang string, n_chars long, other string")
    for name, fn in (
        ("N_WORDS", lambda d: quality_rules(d)), ("Kept", lambda d: quality_rules(d)), ("Score", lambda d: identify(d, train(docs))), ("LANG_PRED", lambda d: identify(d, train(docs))),
        ("IDS", encode_pieces), ("N_Tokens", token_counts), ("Fingerprint", fingerprints), ("TEXT__", remove_repeated), ("Key", lambda d: near_dups(d)), ("Part", lambda d: pack(pieces(d))),
    ):
        out = fn(odd.withColumnRenamed("other", name))
        assert len({c.lower() for c in out.columns}) == len(out.columns) and out.count() == 1, name
    pages = spark.createDataFrame([(1, "http://a.org/x", "v", "t", "f", "h")], "page_id long, url string, Verdict string, tokens__ string, FIXED__ string, hit__ string")
    out = url_filter(pages, [])
    assert {"tokens__", "FIXED__", "hit__", "verdict"} <= set(out.columns) and out.first().verdict == "allow"


def test_constant_texts_have_a_feature(spark):
    from tidemark.llm.fingerprints import chain_of, likeness

    chains = {t: chain_of(t) for t in ("", "a" * 100, "b" * 5000, "z" * 200, "ab" * 300, "x")}
    assert len(chains[""]) == 0 and all(len(c) == 1 for t, c in chains.items() if t)
    for a, x in chains.items():
        for b, y in chains.items():
            assert likeness(x, y) == 1.0 if a == b else likeness(x, y) < 0.1


def test_shared_keys_are_split_and_ordered(spark):
    """Null keys and a key that most rows share: every row's next is the next by key and digest."""
    import hashlib

    rows = [(None, f"null {i}") for i in range(40)] + [(5, f"five {i} " * 20) for i in range(60)] + [(i, f"own {i}") for i in range(30)]
    out = compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    expected = sorted((k or -1, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + order[(i + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest()) for i, (k, t) in enumerate(order))
    assert sorted((r.key or -1, r.n_chars, r.edited_sha256) for r in out) == [e if e[0] else (-1, *e[1:]) for e in expected]


def test_url_filter(spark):
    rows = [(1, None), (2, ""), (3, "http://A.example.org/es/1?x#y"), (3, "http://A.example.org/es/1?x#y"), (4, "no scheme"), (5, "http://" + "a/" * 5000)]
    pages = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, host string, verdict string")
    rules = [{"tokens": ["word=a"], "verdict": "block", "confidence": 0.9, "support": 0.1}]
    out = url_filter(pages, rules).orderBy("page_id").collect()
    assert [(r.host, r.rule, r.verdict) for r in out] == [("", None, "allow"), ("", None, "allow"), ("a.example.org", "example.org/es/", "block"), ("a.example.org", "example.org/es/", "block"), ("", None, "allow"), ("a", None, "block")]
    assert url_filter(pages.limit(0), []).count() == 0
    assert mine_rules(pages.limit(0)) == []


def test_every_query_runs_on_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "pages"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in entry.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_work_tables_can_be_dropped(spark):
    kept = common.written(spark.range(3), "test-drop")
    assert kept.count() == 3 and common.drop_work_tables(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.*exist|no such"):
        kept.count()
