"""Training of the language machines: little memory on the driver, few passes over all rows."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import lang_id
from tidemark.llm.lang_id import DIMENSIONS, Machine


def _units(rng, n):
    x = rng.random((n, DIMENSIONS), np.float32) * (rng.random((n, DIMENSIONS), np.float32) < 0.3)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)


def test_steps_take_little_memory():
    """Besides the rows in half precision, a step holds one number for each pair of rows and a few blocks."""
    rng = np.random.default_rng(7)
    x, weight = _units(rng, 1800), rng.uniform(5, 30, 1800)
    machine = Machine(np.zeros(DIMENSIONS + 1))
    machine.gradient = rng.normal(size=DIMENSIONS + 1)
    tracemalloc.start()
    machine.aim(x, weight, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * len(x) ** 2 + 32e6
    d = machine.direction
    product = d + np.append((weight * (x.astype(np.float64) @ d[:-1] + d[-1])) @ x.astype(np.float64), weight @ (x.astype(np.float64) @ d[:-1] + d[-1]))
    assert np.linalg.norm(product + machine.gradient) < 1e-3 * np.linalg.norm(machine.gradient)


def test_reach_bounds_every_margin():
    rng = np.random.default_rng(8)
    x = _units(rng, 500).astype(np.float64)
    machine = Machine(rng.normal(size=DIMENSIONS + 1))
    for k in range(20):
        machine.w = machine.start + rng.normal(size=DIMENSIONS + 1) * (rng.random(DIMENSIONS + 1) < 0.02)
        if k % 2:  # the row that falls most
            change = machine.w - machine.start
            x[0, :] = np.maximum(0, -change[:-1])
            x[0, :] /= np.linalg.norm(x[0])
        fall = x @ (machine.start - machine.w)[:-1] + (machine.start - machine.w)[-1]
        assert np.abs(fall).max() <= machine.reach()


def test_rounded_are_halves(monkeypatch):
    rng = np.random.default_rng(9)
    x = (rng.random((40, DIMENSIONS)) * 10.0 ** -rng.integers(0, 9, (40, DIMENSIONS))).astype(np.float32)
    monkeypatch.setattr(lang_id, "bags", lambda texts: x.copy())
    assert (lang_id.rounded([]) == x.astype(np.float16).astype(np.float32)).all()


def test_few_passes_over_all_rows(spark, sf_dir, monkeypatch):
    """Weights have a gradient near zero over all rows, also where no last pass over them tells so."""
    passes, real = [], lang_id.written
    monkeypatch.setattr(lang_id, "written", lambda df, name: passes.append(name) or real(df, name))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lang_id.train(docs)
    assert len(passes) <= 3
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang").collect()
    x = lang_id.bags([r.text for r in rows]).astype(np.float16).astype(np.float64)
    for duels, of in [(model.families, lang_id.family_of), *[(d, str) for d in model.inside.values()]]:
        for (a, b), w in zip(duels.pairs, duels.weights.astype(np.float64), strict=True):
            y = np.array([(of(r.lang) == duels.names[a]) * 1.0 - (of(r.lang) == duels.names[b]) for r in rows])
            langs = np.array([r.lang for r in rows])
            c = np.zeros(len(y))
            for side in (1, -1):
                own = sorted(set(langs[y == side]))
                for v in own:
                    c[langs == v] = lang_id.COST * (y != 0).sum() * 0.5 / (len(own) * (langs == v).sum())
            pull = c * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) * y
            assert np.linalg.norm(w - np.append(pull @ x, pull.sum())) < 1e-3 * max(1, np.linalg.norm(w))


def test_first_machines_copy_few_rows():
    """The pipeline's driver has little left beside Spark: machines that all rows take part in don't copy them."""
    rng = np.random.default_rng(10)
    x = np.concatenate([_units(rng, 400) for _ in range(4)]).astype(np.float32)
    x[np.arange(1600), np.arange(1600) // 400] += 1
    tracemalloc.start()
    model = lang_id.LanguageModel(x, np.repeat(["de", "en", "es", "fr"], 400).tolist())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.known) == 4 and most < 0.75 * x.nbytes
