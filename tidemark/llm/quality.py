"""Operator 3, quality rules with tokeniser fertility.

Beside the base rules on words, lines and repetition, a public vocabulary with byte
fallback measures how a text falls into tokens: characters per token, share of tokens
that are byte fallbacks, and the entropy of the token distribution.  Letters per token
are a further measure, so that decoration, which makes long tokens, doesn't pass for
fertility.  A text is rejected when a measure leaves the band of its language, or of its
script where the language has no band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U64, bytes_of, column_of, free_name, in_arrow, map_batches, mix, others, probable, public_vocabulary, text_slices, texts_of, written
from tidemark.llm.near_dup import FACTORS, words
from tidemark.llm.word_bpe import LETTER, char_classes

SYMBOLS = "#*$%&|<>"
#: Script -> (first, last code point) ranges that decide it.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
#: Script -> least and most characters per token, least and most letters per token, most byte-fallback share, least token entropy (bits).
BANDS = {
    "latin": (1.4, 12.0, 1.2, 8.0, 0.3, 2.5),
    "greek": (0.7, 9.0, 0.6, 6.0, 0.3, 2.5),
    "cyrillic": (1.0, 10.0, 0.9, 7.0, 0.3, 2.5),
    "hebrew": (0.6, 9.0, 0.5, 6.0, 0.5, 2.5),
    "arabic": (0.6, 9.0, 0.5, 6.0, 0.5, 2.5),
    "indic": (0.25, 9.0, 0.2, 6.0, 0.95, 2.0),
    "thai": (0.25, 9.0, 0.2, 6.0, 0.95, 2.0),
    "kana": (0.25, 9.0, 0.2, 6.0, 0.95, 2.0),
    "hangul": (0.25, 9.0, 0.2, 6.0, 0.95, 2.0),
    "han": (0.25, 9.0, 0.2, 6.0, 0.95, 2.0),
    "other": (0.1, 16.0, 0.1, 12.0, 0.98, 1.5),
}
#: Bits of a digit of the radix selection; a number that isn't negative has 63.
RADIX = 21
_kinds: list[np.ndarray] = []
_scripts: list[np.ndarray] = []
_models: dict = {}
NAMES = list(BANDS)
#: Bytes that begin a character of a word (neither white space nor a character's later bytes); symbols.
_char = np.array([b & 0xC0 != 0x80 and b not in b" \t\n\x0b\x0c\r" for b in range(256)])
_symbol = np.array([b in SYMBOLS.encode() for b in range(256)])
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_per_token", "letters_per_token", "byte_fallback", "token_entropy", "script"]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _kinds:
        kinds = char_classes()
        script = np.full(len(kinds), NAMES.index("other"), np.uint8)
        for name, ranges in SCRIPTS.items():
            for lo, hi in ranges:
                script[lo : hi + 1] = NAMES.index(name)
        _kinds.append(kinds == LETTER)
        _scripts.append(script)
    return _kinds[0], _scripts[0]


def base_counts(data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    hashes, doc, _, _ = words(data, offsets, lower=False)
    n = len(hashes)
    counts = np.bincount(doc, minlength=len(texts))
    repeat = np.zeros(n, bool)
    if n >= 3:
        same = np.flatnonzero(doc[2:] == doc[:-2])
        window = mix(hashes[same] * FACTORS[0] + hashes[same + 1] * FACTORS[1] + hashes[same + 2] * FACTORS[2] + mix(doc[same].astype(U64)))
        order = np.argsort(window)
        ranked = window[order]
        twin = np.zeros(len(order), bool)
        equal = ranked[1:] == ranked[:-1]
        twin[1:] |= equal
        twin[:-1] |= equal
        hit = same[order[twin]]
        for k in range(3):
            repeat[hit + k] = True
    repeats = np.bincount(doc[repeat], minlength=len(texts))
    chars, symbols = (_per_text(table[data], offsets) for table in (_char, _symbol))
    out = []
    for text, words_n, chars_n, symbols_n, repeat_n in zip(texts, counts.tolist(), chars, symbols, repeats.tolist(), strict=True):
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")] if "\n" in text else ()
        out.append((words_n, chars_n, symbols_n, len(lines) - len(set(lines)), repeat_n))
    return out


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> list[int]:
    return np.diff(np.r_[0, np.cumsum(marks, dtype=np.int64)][offsets]).tolist()


def fertility(texts: list[str], vocabulary: str) -> list[tuple[float | None, float | None, float | None, float | None, str]]:
    """Characters and letters per token, byte-fallback share, token entropy and script of each text; nulls where there is no token."""
    import sentencepiece

    if vocabulary not in _models:
        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        fallback = np.array([model.is_byte(i) for i in range(model.vocab_size())])
        _models[vocabulary] = model, fallback
    model, fallback = _models[vocabulary]
    letter, script = _tables()
    out = []
    for text, ids in zip(texts, model.encode(texts, num_threads=1), strict=True):
        if not ids:
            out.append((None, None, None, None, "other"))
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = points[letter[points]]
        main = NAMES[int(np.bincount(script[letters]).argmax())] if len(letters) else "other"
        count = np.bincount(np.array(ids, np.int32))
        share = count[count > 0] / len(ids)
        out.append((len(points) / len(ids), len(letters) / len(ids), float(count[fallback[: len(count)]].sum()) / len(ids), float(-(share * np.log2(share)).sum()) + 0.0, main))
    return out


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Base counts and fertility of every text (null: as empty), with the columns ``keep``; no shuffle.

    Columns named like the results give way.
    """
    given = others(docs, MEASURES, keep)
    inner = free_name(docs, "t__")
    rows = docs.select(*[F.col(f"`{c}`") for c in given], F.col(f"`{text}`").alias(inner))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    path = public_vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, fert = [], []
            for begin, end in text_slices(batch, inner):
                texts = texts_of(batch, inner, begin, end)
                base += base_counts(*bytes_of(batch, inner, begin, end), texts)
                fert += fertility(texts, path)
            kinds = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.string()]
            columns = [*zip(*base, strict=True), *zip(*fert, strict=True)] if base else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*given, *MEASURES])

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, letters_per_token double, byte_fallback double, token_entropy double, script string"
    return in_arrow(rows, run, f"{fields}{', ' if given else ''}{schema}")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def order_statistics(rows: DataFrame, shares: tuple[float, ...], least: int) -> dict[str, np.ndarray]:
    """Exact quantiles of the measures of every group ``v`` of at least ``least`` rows, by share and measure, interpolated as numpy does.

    A radix selection on the bits of the numbers, which are never negative and so order
    like their bits: three digits, each counted in one pre-aggregated pass over all rows.
    The driver sees one row for each group and number that is looked for.
    """
    spark, names = rows.sparkSession, [c for c in rows.columns if c != "v"]

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(batch.column(c).to_numpy().view(np.int64)) for c in names)], names=["v", *names])

    wide = written(map_batches(rows.select("v", *names), bits, f"v string, {', '.join(f'{c} long' for c in names)}"), "quality-bits")
    sizes = {r.v: r.n for r in wide.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).collect()}
    if not sizes:
        return {}
    long = wide.select("v", F.posexplode(F.array(*names)).alias("c", "x"))
    at = {v: np.array(shares) * (n - 1) for v, n in sizes.items()}
    places = {v: sorted({int(f(p)) for p in at[v] for f in (np.floor, np.ceil)}) for v in sizes}
    wanted = [(v, c, place, place, 0) for v in places for c in range(len(names)) for place in places[v]]
    schema, mask = "v string, c int, place long, rank long, head long", (1 << RADIX) - 1
    for shift in range(2 * RADIX, -1, -RADIX):
        want = spark.createDataFrame(wanted, schema)
        near = long.withColumns({"head": F.shiftright("x", shift + RADIX) if shift + RADIX < 63 else F.lit(0).cast("long"), "digit": F.shiftright("x", shift).bitwiseAND(F.lit(mask))})
        counts = near.join(F.broadcast(want.select("v", "c", "head").distinct()), ["v", "c", "head"]).groupBy("v", "c", "head", "digit").agg(F.count(F.lit(1)).alias("n"))
        ranked = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("v", "c", "head").orderBy("digit")))
        found = ranked.join(F.broadcast(want), ["v", "c", "head"]).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        wanted = [tuple(r) for r in found.select("v", "c", "place", F.col("rank") - F.col("upto") + F.col("n"), F.shiftleft("head", RADIX) + F.col("digit")).collect()]
    value = {(v, c, place): x for (v, c, place, _, _), x in zip(wanted, np.array([w[-1] for w in wanted], np.int64).view(np.float64).tolist(), strict=True)}
    # numpy interpolates between both neighbours of a share's place
    out = {}
    for v in sizes:
        pairs = [[np.array([[value[v, c, int(f(p))] for c in range(len(names))] for f in (np.floor, np.ceil)]), p - np.floor(p)] for p in at[v]]
        out[v] = np.array([np.quantile(both, part, axis=0) for both, part in pairs])
    return out


def fit_bands(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label_key: str = "doc_id", quality: str = "quality", least: int = 50) -> dict[str, tuple[float, ...]]:
    """Bands of languages from all rows with a good label.

    A band spans all but a 500th of a language's good texts on either side, and a
    margin; languages with fewer than ``least`` good texts keep their script's band.
    Null labels, keys and languages teach nothing; a key's first label counts; empty tables
    give no bands.  Texts aren't shuffled: a bitmap of the labelled keys picks them where they
    are, and only their measures go through the exact join.
    """
    good = labels.select(F.col(f"`{label_key}`").alias("k"), F.col(f"`{quality}`").alias("q")).filter("k is not null and q is not null")
    good = good.groupBy("k").agg(F.min("q").alias("q")).filter(F.col("q") == 1).select("k")
    own = column_of(docs, lang)
    named = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), (F.col(f"`{own}`").cast("string") if own else F.lit(None).cast("string")).alias("v"))
    kind = named.select("k").union(good).schema["k"].dataType  # keys are hashed, so both have one type
    good = written(good.select(F.col("k").cast(kind).alias("k")), "quality-good")
    named = named.withColumn("k", F.col("k").cast(kind)).filter("k is not null and v is not null")
    found = measures(probable(named, F.col("k"), good, "k"), "t", ["k", "v"]).filter(~base_failed() & F.col("chars_per_token").isNotNull())
    rows = found.join(good, "k", "left_semi").select("v", "chars_per_token", "letters_per_token", "byte_fallback", "token_entropy")
    out = {}
    for v, (low, high) in sorted(order_statistics(rows, (0.002, 0.998), least).items()):
        out[v] = (float(low[0] * 0.96), float(high[0] * 1.05), float(low[1] * 0.96), float(high[1] * 1.05), float(high[2] * 2 + 0.02), float(low[3] * 0.85))
    return out


def quality_rules(docs: DataFrame, bands: dict[str, tuple[float, ...]] | None = None, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Measures of every text with ``base_failed``, the ``reason`` of a rejection and ``kept``.

    Null and empty texts have no words and fail.  A null or unknown language, or a
    table without ``lang``, leaves the script's band.  Columns named like the results, in
    any case, give way.  Repeated rows stay repeated; an empty table gives an empty one.
    """
    given = others(docs, ["base_failed", "reason", "kept", *MEASURES], keep)
    extra, named = free_name(docs, "v__"), column_of(docs, lang)
    rows = docs.withColumn(extra, F.col(f"`{named}`").cast("string") if named else F.lit(None).cast("string"))
    found = measures(rows, text, [*given, extra])
    table = {**{f"script {k}": v for k, v in BANDS.items()}, **{f"lang {k}": v for k, v in (bands or {}).items()}}
    lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    band = F.coalesce(F.try_element_at(lookup, F.concat(F.lit("lang "), F.col(extra))), F.try_element_at(lookup, F.concat(F.lit("script "), F.col("script"))))
    own = free_name(docs, "band__")
    found = found.withColumn(own, band).withColumn("base_failed", base_failed())
    reason = (
        F.when(F.col("base_failed"), F.when(F.col("n_words") < 50, F.lit("short")).otherwise(F.lit("repetition")))
        .when(F.col("chars_per_token").isNull(), F.lit("no tokens"))
        .when(F.col("chars_per_token") < F.col(own)[0], F.lit("few characters per token"))
        .when(F.col("chars_per_token") > F.col(own)[1], F.lit("many characters per token"))
        .when(F.col("letters_per_token") < F.col(own)[2], F.lit("few letters per token"))
        .when(F.col("letters_per_token") > F.col(own)[3], F.lit("many letters per token"))
        .when(F.col("byte_fallback") > F.col(own)[4], F.lit("byte fallback"))
        .when(F.col("token_entropy") < F.col(own)[5], F.lit("low token entropy"))
    )
    return found.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop(own, extra)


def op3_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, fertility and verdict of every document, with bands fitted on its labelled ones."""
    found = quality_rules(docs, fit_bands(docs, labels), keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "letters_per_token", "byte_fallback", "token_entropy", "script", "reason")
