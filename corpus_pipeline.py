"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  Rejected documents are gone for the
later stages; all but the last stage return the columns of ``documents``, and further
ones that the table has, whatever their names.  Repeated rows stay rows of their own, and an
empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, join_few, written
from tidemark.llm.lang_id import identify, train
from tidemark.llm.near_dup import near_dups
from tidemark.llm.packing import pack, pieces
from tidemark.llm.quality import fit_bands, quality_rules
from tidemark.llm.suffix_dedup import remove_repeated

#: A text whose language the machines doubt (a margin below zero) or that has none goes.
MIN_LANGUAGE_SCORE = 0.5
#: Passages of over 50 words that come again are taken out, whatever their bytes.
PASSAGE_WORDS = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; bands are fitted on labelled rows of this stage's input.  Null and empty texts go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # extra columns keep their values, whatever they are called
    apart = {c: f"c{i}__" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    judged = quality_rules(docs.withColumnsRenamed(apart), fit_bands(docs, labels)).filter("kept")
    return judged.withColumns({c: F.col(a) for c, a in apart.items()}).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; null texts and texts without a letter have none, a null ``lang`` teaches nothing."""
    named, score = free_name(docs, "lang_pred__"), free_name(docs, "score__")
    found = identify(docs, train(docs), out=(named, score))
    return found.filter((F.col(named) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id (all rows with that doc_id).

    Texts without words are linked with nothing and stay; of a group with null doc_ids only, all rows stay.
    """
    own = free_name(docs, "k__")
    found = written(near_dups(docs).select(F.col("key").alias(own), F.col("key").eqNullSafe(F.col("component")).alias("kept")), "pipeline-found")
    # most documents stay: only those whose doc_id may be dropped go through a join
    dropped = written(found.groupBy(own).agg(F.max("kept").alias("kept")).filter("not kept").select(own, F.lit(True).alias(f"{own}x")), "pipeline-dropped")
    return join_few(docs, F.col("doc_id"), dropped, own).filter(F.col(f"{own}x").isNull()).select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of windows of 51 words or of 400 bytes that repeat; n_chars follows the text, null texts stay null."""
    out = remove_repeated(docs, words=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset; a null or empty text is one piece, its end id."""
    placed = pack(pieces(docs))
    return placed.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("language ID", language), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", suffix_dedup), ("best-fit packing", packing)]

#: SQL can express neither the tokenizers nor the machines; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
