"""Operator 5, token counts by a compiled finite-state tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, map_batches, others, public_vocabulary, text_slices, texts_of
from tidemark.llm.word_bpe import WordBpeCounter

_counters: dict[str, WordBpeCounter] = {}


def counter(path: str) -> WordBpeCounter:
    """One compiled transducer for each vocabulary and Python worker."""
    if path not in _counters:
        _counters[path] = WordBpeCounter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame, text: str = "text", vocabulary: str = "word_bpe_49k.json", out: str = "n_tokens", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` and its tokens as the tokenizers library counts them, in a column ``out``.

    Special tokens are not added; their strings inside a text count as one token, as
    by the library's default.  A null or empty text has 0.  The columns ``keep`` (all by
    default) pass through; one named like ``out`` gives way.  Repeated rows stay
    repeated; an empty table gives an empty table.  One narrow stage: a scanner
    transducer cuts words, a BPE transducer annotates its transitions with token counts,
    chunks of the byte stream run side by side and their state maps and counts compose
    by prefix sums.
    """
    given = others(docs, [out], keep)
    inner = free_name(docs, "t__")
    rows = docs.select(*[F.col(f"`{c}`") for c in given], F.col(f"`{text}`").alias(inner))
    path = public_vocabulary(vocabulary)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.LongType())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[int] = []
        for begin, end in text_slices(batch, inner):
            found += counter(path).counts(texts_of(batch, inner, begin, end))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(given))), pa.array(found, pa.int64())], names=[*given, out])

    return map_batches(rows, count, schema)


def op5_token_counts(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """Bytes, tokens and whether these exceed ``limit``."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return token_counts(sized, keep=["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > limit)
