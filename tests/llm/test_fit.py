"""Bands of the quality rules are those of all labelled rows."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import public_vocabulary
from tidemark.llm.quality import fertility, fit_bands, order_statistics

NAMES = ["chars_per_token", "letters_per_token", "byte_fallback", "token_entropy"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """7,500 texts in two languages, most with a good label, some with a bad one, two or none.

    Texts of common words, of many characters per token, have the keys that come last by a hash: a sample of 6,000 has none of them.
    """
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeinorstlmk"), rng.integers(2, 9))) for _ in range(400)]
    common = "international government development information university department different important following community".split()
    last = {r.id for r in spark.range(7500).orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(3)).desc()).limit(100).collect()}
    rows = [(i, " ".join(rng.permutation(common * 6) if i in last else rng.choice(words, 60)), "en" if i % 3 else "de", "s", 0) for i in range(7500)]
    labels = [(i, 0 if i % 50 == 0 else 1, 0) for i in range(7500) if i % 40 != 7] + [(i, 0, 0) for i in range(11, 7500, 70)]
    folder = str(tmp_path_factory.mktemp("fit"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id int, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bad = {i for i, q, _ in labels if not q}
    good = {i for i, q, _ in labels if q} - bad
    assert len(good) > 6500
    return folder, [r for r in rows if r[0] in good]


def expected(rows):
    out = {}
    for v in {r[2] for r in rows}:
        a = np.array([m[:4] for m in fertility([r[1] for r in rows if r[2] == v], public_vocabulary("piece_bpe_32k.model"))])
        low, high = np.quantile(a, 0.002, axis=0), np.quantile(a, 0.998, axis=0)
        out[v] = (low[0] * 0.96, high[0] * 1.05, low[1] * 0.96, high[1] * 1.05, high[2] * 2 + 0.02, low[3] * 0.85)
    return out


def test_bands_of_all_labelled_rows(spark, table):
    folder, good = table
    bands, brute = fit_bands(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")), expected(good)
    assert bands.keys() == brute.keys()
    for v in brute:
        assert bands[v] == pytest.approx(brute[v], rel=1e-12)


def test_order_statistics(spark):
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", *x) for i, x in enumerate(np.c_[rng.random(3000), rng.choice([0.0, 0.0, 0.5], 3000), np.full(3000, 2.5), rng.exponential(1e-5, 3000)].tolist())]
    rows += [("few", 1.0, 1.0, 1.0, 1.0)] * 9
    found = order_statistics(spark.createDataFrame(rows, "v string, " + ", ".join(f"{c} double" for c in NAMES)), (0.0, 0.002, 0.5, 0.998, 1.0), 10)
    assert found.keys() == {"a", "b"}
    for v in found:
        a = np.array([r[1:] for r in rows if r[0] == v])
        np.testing.assert_allclose(found[v], np.quantile(a, (0.0, 0.002, 0.5, 0.998, 1.0), axis=0), rtol=1e-12)


def test_the_pipelines_stage_keeps_what_all_labels_allow(spark, table):
    folder, _ = table
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, folder).select("doc_id").collect()}
    common = {r.doc_id for r in docs.filter("text like '%international%'").select("doc_id").collect()}
    assert len(common) == 100
    assert common <= kept
