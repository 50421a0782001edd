"""Machines of the language identification are those of all labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.lang_id import bags, identify, train


def test_machines_of_all_labelled_rows(spark):
    """5,000 texts; the ones of German that look like English have the keys that come last by a hash, so a sample of 4,000 has none of them."""
    rng = np.random.default_rng(7)
    common = ["".join(rng.choice(list("aeinorstlm"), rng.integers(2, 8))) for _ in range(300)]
    mark = ["".join(rng.choice(list("kwzbg"), rng.integers(2, 8))) for _ in range(300)]
    last = {r.id for r in spark.range(5000).orderBy(F.xxhash64(F.col("id").cast("string")).desc()).limit(80).collect()}
    rows = []
    for i in range(5000):
        lang = "de" if i in last or i % 2 else "en"
        words = [*rng.choice(common, 30)] + [*rng.choice(mark, 3 if i in last else 15 if lang == "de" else 1)]
        rows.append((i, " ".join(rng.permutation(words)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = train(docs)
    (w,) = model.inside["germanic"].weights.astype(np.float64)
    x = bags([r[1] for r in rows]).astype(np.float16).astype(np.float64)
    y = np.array([1.0 if r[2] == "de" else -1.0 for r in rows])
    c = 10.0 * len(y) * np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    pull = c * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) * y
    assert np.linalg.norm(w - np.append(pull @ x, pull.sum())) < 0.01 * np.linalg.norm(w)
    found = {r.doc_id: r.lang_pred for r in identify(docs, model).select("doc_id", "lang_pred").collect()}
    assert all(found[i] == "de" for i in last)
