"""Contexts of grams leave in batches of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import contexts


def test_contexts_come_in_small_batches(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CONTEXT_BYTES", 50_000)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, 400 + 90 * (i % 40), dtype=np.uint8)) for i in range(300)]
    at = [[{"gram": 2 * j, "place": j, "blocks": 1} for j in range(0, len(t) - 128, 100)] for t in texts]
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("place", pa.int32()), ("blocks", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([b"%d" % i for i in range(300)], pa.binary()), pa.array([zstandard.compress(t) for t in texts], pa.binary()), pa.array(at, kind)], names=["node", "z", "at"])
    found = list(contexts(iter([batch.slice(0, 0), batch]), [(400, 128, np.uint8)]))
    assert max(sum(map(len, b.column("context").to_pylist())) for b in found) < 51_000
    rows = [(r["node"], r["gram"], r["lo"], r["inside"], r["context"]) for b in found for r in b.to_pylist()]
    assert rows == [(b"%d" % i, m["gram"], max(0, m["place"] - 272), min(272, m["place"]), t[max(0, m["place"] - 272) : m["place"] + 400]) for i, (t, a) in enumerate(zip(texts, at, strict=True)) for m in a]
