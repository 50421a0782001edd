"""Operator 6, hierarchical language identification.

Texts are hashed bags of byte 2-, 3- and 4-grams.  Linear support vector machines
(squared hinge) tell each pair of families apart, and one-versus-one machines each
pair of languages inside a family; a level's winner is the class with the most
won duels, then the larger sum of margins.  A machine's weights are the minimum of its
loss over all labelled rows, whole texts, each language weighing the same: executors sum
losses and gradients over all rows, and only rows near a margin are looked at between two
such passes, since all others add nothing.  A bounded number of rows (``max_rows``) gives
the weights to start from and the curvature of the steps, neither of which moves the
minimum.  Bags are made on the executors, in half precision.
Prediction sees the text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U64, free_name, give_back, in_arrow, mix, others, text_slices, texts_of, written

#: Branches of the languages' family tree, by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indic": "hi bn ur pa gu mr ne si or as",
    "iranian": "fa ku ps tg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv mg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIMENSIONS = 4096
UNKNOWN = "und"
#: What a row's squared hinge costs, beside the weights' half square.
COST = 10.0
#: Rows with a margin below 1 + NEAR stay in sight until the next pass over all rows.
NEAR = 0.3
#: Training ends when a gradient over all rows is this small beside the weights, or after so many passes over all rows.
TOLERANCE, PASSES = 1e-4, 100
#: Rows in single or double precision at once on the driver.
BLOCK = 256
_letter = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    """A language that the table doesn't have is a family of its own."""
    return FAMILY_OF.get(lang, f"only {lang}")


def bags(texts: list[str]) -> np.ndarray:
    """A unit row of hashed n-gram counts (square roots) for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        code, codes = data, []
        for n in range(2, 5):
            code = code[:-1] * np.uint32(0x01000193) + data[n - 1 :]
            codes.append(code + np.uint32(n))
        np.sqrt(np.bincount((np.concatenate(codes) * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIMENSIONS), out=row, casting="same_kind")
        row /= max(float(np.linalg.norm(row)), 1e-9)
    return out


def svm(x: np.ndarray, positive: np.ndarray, cost: float = COST, steps: int = 60) -> np.ndarray:
    """Weights and bias of an L2 machine with squared hinge loss, by conjugate-gradient Newton steps; classes weigh the same."""
    # the bias is a weight apart; all in 32 bits, so that no product copies the rows
    y = np.where(positive, 1, -1).astype(np.float32)
    weight = (cost * len(y) * np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)

    def scores(v):
        return x @ v[:-1] + v[-1]

    def back(r):
        return np.append(r @ x, r.sum(dtype=np.float32)).astype(np.float32)

    def loss(v):
        m = np.maximum(0, 1 - y * scores(v))
        return 0.5 * float(v @ v) + 0.5 * float(weight @ (m * m))

    for _ in range(steps):
        margin = 1 - y * scores(w)
        active = (margin > 0).astype(np.float32)
        gradient = w - back(active * weight * y * margin)
        if np.linalg.norm(gradient) < 1e-3 * max(1.0, float(np.linalg.norm(w))):
            break
        c = active * weight
        step, r = np.zeros_like(w), -gradient
        p, rr = r.copy(), float(r @ r)
        for _ in range(25):
            hp = p + back(c * scores(p))
            alpha = np.float32(rr / float(p @ hp))
            step += alpha * p
            r -= alpha * hp
            new = float(r @ r)
            if new < 1e-4 * float(gradient @ gradient):
                break
            p, rr = r + np.float32(new / rr) * p, new
        t, here = 1.0, loss(w)
        while loss(w + np.float32(t) * step) >= here and t > 1e-4:
            t /= 2
        if t <= 1e-4:
            break
        w = w + np.float32(t) * step
    return w


class Duels:
    """One-versus-one machines between named classes."""

    def __init__(self, names: list[str], x: np.ndarray, labels: np.ndarray):
        self.names = names
        self.pairs = list(combinations(range(len(names)), 2))
        machines = []
        for a, b in self.pairs:
            rows = (labels == names[a]) | (labels == names[b])
            machines.append(svm(x if rows.all() else x[rows], labels[rows] == names[a]))
        self.weights = np.array(machines, np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def winners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the winning class and its least margin over a rival."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), np.int64), np.full(len(x), 3.0)
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        wins, sums = np.zeros((len(x), n)), np.zeros((len(x), n))
        worst = np.full((len(x), n), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            wins[:, a] += m >= 0
            wins[:, b] += m < 0
            sums[:, a] += m
            sums[:, b] -= m
            worst[:, a] = np.minimum(worst[:, a], m)
            worst[:, b] = np.minimum(worst[:, b], -m)
        best = np.lexsort((-sums, -wins), axis=1)[:, 0] if n > 2 else (margins[:, 0] < 0).astype(np.int64)
        return best, worst[np.arange(len(x)), best]


class LanguageModel:
    """Machines between families, then inside each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        """Learn from rows of ``bags`` and their languages."""
        self.known = sorted(set(langs))
        if not self.known:
            return
        labels = np.array(langs, object)
        families = np.array([family_of(v) for v in langs], object)
        self.families = Duels(sorted(set(families)), x, families)
        self.inside = {f: Duels(sorted(set(labels[families == f])), x[families == f], labels[families == f]) for f in self.families.names}

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text; unknown, 0 where there is no letter or nothing was learned."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.known and t and _letter.search(t)]
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            x = bags([texts[i] for i in part])
            first, margin = self.families.winners(x)
            for f in np.unique(first):
                mine = np.flatnonzero(first == f)
                duels = self.inside[self.families.names[f]]
                best, inner = duels.winners(x[mine])
                least = np.minimum(margin[mine], inner)
                for i, b, m in zip(mine.tolist(), best.tolist(), least.tolist(), strict=True):
                    out[part[i]] = (duels.names[b], float(1 / (1 + np.exp(-2 * m))))
        return out


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``x`` with ``a @ x = b`` by Cholesky's factors, which take the place of the lower half of the positive definite ``a``: no copy of it is made."""
    n, x = len(a), b.astype(np.float64)
    parts = [slice(i, min(i + BLOCK, n)) for i in range(0, n, BLOCK)]
    for p in parts:
        a[p, p] = np.linalg.cholesky(a[p, p])
        x[p] = np.linalg.solve(a[p, p], x[p])
        if p.stop < n:
            a[p.stop :, p] = np.linalg.solve(a[p, p], a[p.stop :, p].T).T
            x[p.stop :] -= a[p.stop :, p] @ x[p]
        for r in parts:
            if r.start >= p.stop:
                a[r, p.stop : r.stop] -= a[r, p] @ a[p.stop : r.stop, p].T
    for p in reversed(parts):
        x[p] = np.linalg.solve(a[p, p].T, x[p] - a[p.stop :, p].T @ x[p.stop :])
    return x


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Margins of rows in half precision, some rows at a time."""
    return np.concatenate([x[i : i + BLOCK].astype(np.float64) @ w[:-1] + w[-1] for i in range(0, max(1, len(x)), BLOCK)])


class Machine:
    """A machine on its way to the least loss: Newton steps over the rows at hand, corrected by the last few gradients."""

    def __init__(self, weights: np.ndarray):
        self.w = weights.astype(np.float64)
        self.start, self.trial, self.pairs, self.enough = self.w, self.w, [], np.inf

    def begin(self, loss: float, gradient: np.ndarray, active: int, enough: float) -> None:
        """Take the loss over all rows at the weights as they are; steps end at a gradient of ``enough``."""
        self.loss, self.gradient, self.active, self.pairs = loss, gradient, active, []
        self.start, self.enough = self.w, enough
        self.open = float(np.linalg.norm(gradient)) > self.enough

    def size(self) -> float:
        return max(1.0, float(np.linalg.norm(self.w)))

    def reach(self) -> float:
        """No row's margin may have fallen by more since ``begin``: bags have no item below zero and (rounded) no norm above 1.001."""
        change = self.w - self.start
        up, down = (1.001 * float(np.linalg.norm(np.maximum(0, sign * change[:-1]))) for sign in (1, -1))
        return max(down - change[-1], up + change[-1])

    def aim(self, x: np.ndarray, weight: np.ndarray, whole: bool) -> None:
        """Set out for the minimum by the curvature of active rows ``x`` with their weights; unless they are the ``whole``, earlier gradients correct it.

        Rows stay in half precision but for a few at a time; the only large array beside them is one number for each two rows.
        """
        if whole:
            self.pairs = []
        q, back = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            back.append(float(s @ q) / float(s @ y))
            q -= back[-1] * y
        inner, starts = np.empty((len(x), len(x))), range(0, len(x), BLOCK)
        for i in starts:
            a = x[i : i + BLOCK].astype(np.float32)
            for j in range(0, i + 1, BLOCK):
                inner[i : i + BLOCK, j : j + BLOCK] = a @ x[j : j + BLOCK].astype(np.float32).T
        inner += 1
        inner[np.diag_indices(len(x))] += 1 / weight
        pull = solved(inner, scores(x, q))
        for i in starts:
            q[:-1] -= pull[i : i + BLOCK] @ x[i : i + BLOCK].astype(np.float64)
        q[-1] -= pull.sum()
        for s, y in self.pairs:
            q += s * (back.pop() - float(y @ q) / float(s @ y))
        self.direction, self.t = -q, 1.0
        self.slope = float(self.gradient @ self.direction)
        self.trial = self.w + self.direction

    def judge(self, loss: float, gradient: np.ndarray, active: int) -> bool:
        """Take the trial if it lowers the loss, else come nearer along the line; whether the line is done with."""
        if loss > self.loss + 1e-4 * self.t * self.slope:
            ahead = float(gradient @ self.direction)
            self.t *= float(np.clip(-self.slope / max(ahead - self.slope, 1e-300), 0.1, 0.7))
            self.open = self.t > 1e-8
            self.trial = self.w + self.t * self.direction if self.open else self.w
            return not self.open
        step, change = self.trial - self.w, gradient - self.gradient
        if float(step @ change) > 0:
            self.pairs = [*self.pairs[-7:], (step, change)]
        self.w, self.loss, self.gradient, self.active = self.trial, loss, gradient, active
        self.open = float(np.linalg.norm(gradient)) > self.enough
        return True


def rounded(texts: list[str]) -> np.ndarray:
    """``bags`` with the values of half precision, by their bits: about ten times as fast as there and back."""
    x = bags(texts)
    bits = x.view(np.uint32)
    low = (x > 0) & (x < 2.0**-14)  # a half's last bit is another one there
    exact = x[low].astype(np.float16)
    bits += np.uint32(0xFFF) + ((bits >> np.uint32(13)) & np.uint32(1))
    bits &= np.uint32(0xFFFFE000)
    x[low] = exact
    return x


def seen(batches: Iterator[pa.RecordBatch], known: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Number of the language, hash and bag of the rows of a table of texts ``t`` or of bags."""
    for batch in batches:
        text = "t" in batch.schema.names
        for begin, end in text_slices(batch, "t") if text else [(0, batch.num_rows)]:
            part = batch.slice(begin, end - begin)
            x = rounded(texts_of(batch, "t", begin, end)) if text else np.frombuffer(b"".join(part.column("bag").to_pylist()), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
            yield np.array([known.index(v) for v in part.column("v").to_pylist()], np.int64), part.column("v"), part.column("h"), x


def losses(rows: DataFrame, known: list[str], sign: np.ndarray, weight: np.ndarray, points: np.ndarray, near: bool) -> DataFrame:
    """Sums of the machines' losses at ``points`` over ``rows`` by task, one row (m >= 0) for each machine: loss, gradient as bytes and number of active rows.

    With ``near``, the rows (m = -1) near a margin, too: their language, hash and bag.
    """
    shared = rows.sparkSession.sparkContext.broadcast((sign, weight, points))
    schema = pa.schema([("m", pa.int32()), ("v", pa.string()), ("h", pa.int64()), ("bag", pa.binary()), ("loss", pa.float64()), ("active", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, weight, points = shared.value
        flat, n = points[:, :-1].astype(np.float32).T, len(points)
        loss, gradient, active = np.zeros(n), np.zeros_like(points), np.zeros(n, np.int64)
        for code, v, h, all_x in seen(batches, known):
            x, y = all_x, sign[:, code].T
            some = np.flatnonzero(((y != 0) & (y * (x @ flat + points[:, -1]) < 1 + NEAR)).any(1))
            if not len(some):
                continue
            x, y, c = x[some].astype(np.float64), y[some], weight[:, code[some]].T
            hinge = np.where(y != 0, np.maximum(0, 1 - y * (x @ points[:, :-1].T + points[:, -1])), 0)
            pull = c * hinge * y
            loss += 0.5 * (c * hinge * hinge).sum(0)
            gradient[:, :-1] -= pull.T @ x
            gradient[:, -1] -= pull.sum(0)
            active += (hinge > 0).sum(0)
            if near:
                own, k = pa.array(some), len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, -1, np.int32)), v.take(own), h.take(own), pa.array([r.tobytes() for r in all_x[some].astype(np.float16)], pa.binary()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64())], schema=schema)
        if active.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array([g.tobytes() for g in gradient], pa.binary()), pa.array(loss), pa.array(active)], schema=schema)

    return in_arrow(rows, run, "m int, v string, h long, bag binary, loss double, active long")


def summed(parts: DataFrame, points: np.ndarray) -> list[tuple[float, np.ndarray, int]]:
    """Loss, gradient and number of active rows of each machine from ``losses``; its tasks' sums are added up on the executors, in 64 shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                old = found.get(r["m"], (0.0, 0, 0))
                found[r["m"]] = old[0] + r["loss"], old[1] + np.frombuffer(r["bag"], np.float64), old[2] + r["active"]
        if found:
            yield pa.RecordBatch.from_pylist([{"m": m, "loss": a, "bag": b.tobytes(), "active": c} for m, (a, b, c) in found.items()], schema=pa.schema([("m", pa.int32()), ("loss", pa.float64()), ("bag", pa.binary()), ("active", pa.int64())]))

    dealt = parts.filter("m >= 0").select("m", "loss", "bag", "active", (F.spark_partition_id() % 64).alias("share")).repartition("share").drop("share")
    out = [(0.5 * float(w @ w), w.copy(), 0) for w in points]
    for r in in_arrow(dealt, run, "m int, loss double, bag binary, active long").toArrow().sort_by([("m", "ascending"), ("loss", "ascending")]).to_pylist():
        a, b, c = out[r["m"]]
        out[r["m"]] = a + r["loss"], b + np.frombuffer(r["bag"], np.float64), c + r["active"]
    return out


def active_rows(near: DataFrame, known: list[str], sign: np.ndarray, points: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages, places from 0 to 1, and bags of rows that are active in a machine, as many as its ``share`` lets through.

    Places are hashes of the key and the row's number in its task, so that a repeated key's rows part.
    """
    shared = near.sparkSession.sparkContext.broadcast((sign, points, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (sign, points, share), done = shared.value, 0
        for code, v, h, x in seen(batches, known):
            at = (mix(h.to_numpy().view(U64) + np.arange(done, done + len(code), dtype=U64)) >> U64(11)) / 2.0**53
            done += len(code)
            y = sign[:, code].T
            hit = (y != 0) & (y * (x.astype(np.float64) @ points[:, :-1].T + points[:, -1]) < 1) & (at[:, None] < share)
            own = np.flatnonzero(hit.any(1))
            yield pa.RecordBatch.from_arrays([v.take(pa.array(own)), pa.array(at[own]), pa.array([r.tobytes() for r in x[own].astype(np.float16)], pa.binary())], names=["v", "at", "bag"])

    found = in_arrow(near, run, "v string, at double, bag binary").toArrow()
    order = pa.compute.sort_indices(found, [("at", "ascending"), ("v", "ascending"), ("bag", "ascending")])
    x, column = np.empty((found.num_rows, DIMENSIONS), np.float16), found.column("bag")
    for i, k in enumerate(order.to_pylist()):
        x[i] = np.frombuffer(column[k].as_buffer(), np.float16)
    return np.array([known.index(v) for v in found.column("v").take(order).to_pylist()], np.int64), found.column("at").take(order).to_numpy(), x


def refine(rows: DataFrame, model: LanguageModel, counts: dict[str, int], max_rows: int, tolerance: float) -> None:
    """Bring the machines of ``model`` to the least loss over all ``rows`` (v, h, t).

    A pass over all rows gives the gradients and a table of the rows near a margin; over
    it the machines descend until their gradients are small, and the next pass tells
    whether they are so over all rows.  No pass is needed for that where weights moved so
    little that no row outside the table can have become active: its sums are those of all rows.
    """
    known = model.known
    duels = [(d, k, (lambda v: v) if d is not model.families else family_of) for d in (model.families, *model.inside.values()) for k in range(len(d.pairs))]
    if not duels:
        return
    sign = np.array([[(of(v) == d.names[d.pairs[k][0]]) * 1.0 - (of(v) == d.names[d.pairs[k][1]]) for v in known] for d, k, of in duels])
    n = np.array([counts[v] for v in known], np.float64)
    total = ((sign != 0) * n).sum(1, keepdims=True)
    sides = np.where(sign > 0, (sign > 0).sum(1, keepdims=True), (sign < 0).sum(1, keepdims=True))
    weight = np.where(sign != 0, COST * total * 0.5 / (np.maximum(sides, 1) * n), 0)
    machines = [Machine(d.weights[k]) for d, k, _ in duels]
    for turn in range(PASSES):
        before = [m.w for m in machines]
        points = np.array(before)
        found = written(losses(rows, known, sign, weight, points, True), "language-near")
        for m, (loss, gradient, active) in zip(machines, summed(found, points), strict=True):
            # the first table lacks rows that come near later, so it isn't worth small steps
            m.begin(loss, gradient, active, max(tolerance / 10 * m.size(), 0.0 if turn else 0.03 * float(np.linalg.norm(gradient))))
        if all(np.linalg.norm(m.gradient) <= tolerance * m.size() for m in machines):
            break
        near = found.filter("m = -1").select("v", "h", "bag")
        while any(m.open for m in machines):
            part = min(1.0, max_rows / max(1, sum(m.active for m in machines if m.open)))
            share = np.array([part if m.open else 0.0 for m in machines])
            code, at, x = active_rows(near, known, sign, np.array([m.w for m in machines]), share)
            for i, m in enumerate(machines):
                if m.open:
                    y = sign[i, code]
                    mine = np.flatnonzero((y != 0) & (at < share[i]) & (y * scores(x, m.w) < 1))
                    m.aim(x[mine], weight[i, code[mine]] / part, part == 1)
            del x
            give_back()
            trying = {i for i, m in enumerate(machines) if m.open}
            while trying:
                points = np.array([m.trial if i in trying else m.w for i, m in enumerate(machines)])
                values = summed(losses(near, known, sign, weight, points, False), points)
                trying = {i for i in trying if not machines[i].judge(*values[i])}
        if all(m.w is w for m, w in zip(machines, before, strict=True)):
            break  # no step lowers a loss any more
        if all(m.reach() < 0.999 * NEAR and np.linalg.norm(m.gradient) <= tolerance * m.size() for m in machines):
            break
    for (d, k, _), m in zip(duels, machines, strict=True):
        d.weights[k] = m.w
    give_back()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = 4000) -> LanguageModel:
    """Learn from all rows with a label, each language weighing the same; the bags of about ``max_rows`` of them reach the driver at once.

    These, as many of each language as of another, only give the weights to start from and
    the steps' curvature; the last passes are over all rows.
    Null texts, texts without a letter and null languages teach nothing; an empty table
    gives a model that knows no language.
    """
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("v"), F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"))
    rows = rows.filter(F.col("v").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = {r["v"]: r["n"] for r in rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not counts:
        return LanguageModel(np.zeros((0, DIMENSIONS), np.float32), [])
    each = max(1, max_rows // len(counts))
    # a first cut by hash leaves about twice as many, so that the exact one moves few texts
    share = F.create_map(*[F.lit(x) for v, n in counts.items() for x in (v, min(1.0, 2 * each / n + 20 / n))])
    some = rows.filter(F.pmod("h", F.lit(1 << 20)) < F.try_element_at(share, F.col("v")) * (1 << 20))
    exact = some.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("h", "t"))).filter(F.col("r") <= each)

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in text_slices(batch, "t"):
                x = bags(texts_of(batch, "t", begin, end))
                own = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["v", "h", "bag"])

    found = in_arrow(exact.select("v", "h", "t"), bagged, "v string, h long, bag binary").toArrow().sort_by([("v", "ascending"), ("h", "ascending"), ("bag", "ascending")])
    langs, column, x = found.column("v").to_pylist(), found.column("bag"), np.empty((found.num_rows, DIMENSIONS), np.float32)
    del found
    for i in range(len(x)):
        x[i] = np.frombuffer(column[i].as_buffer(), np.float16)
    del column
    give_back()
    model = LanguageModel(x, langs)
    del x
    give_back()
    # from few rows to all of them, four times as many at a step: each step starts where few rows are active
    level = 1
    while sum(counts.values()) > 4 * level * max_rows:
        level *= 4
    while level:
        own = rows if level == 1 else rows.filter(F.pmod(F.shiftright("h", 20), F.lit(1 << 20)) < (1 << 20) // level)
        refine(own, model, counts, max_rows, TOLERANCE if level == 1 else 100 * TOLERANCE)
        level //= 4
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with the predicted language and a score from 0 to 1.

    A null text or one without a letter is ``und`` with score 0, and so is every text
    if nothing was learned.  Columns named like the results, in any case, give way.
    Repeated rows stay repeated; an empty table gives an empty one.
    """
    given = others(docs, out, keep)
    inner = free_name(docs, "t__")
    rows = docs.select(*[F.col(f"`{c}`") for c in given], F.col(f"`{text}`").alias(inner))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few machines of fixed width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, float]] = []
            for begin, end in text_slices(batch, inner):
                found += shared.value.predict(texts_of(batch, inner, begin, end))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*given, *out])

    return in_arrow(rows, run, f"{fields}{', ' if given else ''}`{out[0]}` string, `{out[1]}` double")


def op6_language_id(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2, predict all."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    marked = docs.withColumn("held_out", F.coalesce(held, F.lit(False)))
    model = train(marked.filter("not held_out"))
    return identify(marked, model, keep=["doc_id", "held_out"])
