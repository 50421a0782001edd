"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.fingerprints import op9_fingerprints
from tidemark.llm.lang_id import op6_language_id
from tidemark.llm.near_dup import op7_near_dedup
from tidemark.llm.packing import op4_best_fit_packing
from tidemark.llm.pieces import op2_sentencepiece
from tidemark.llm.quality import op3_quality_rules
from tidemark.llm.suffix_dedup import op10_suffix_dedup
from tidemark.llm.token_counts import op5_token_counts
from tidemark.llm.token_store import op8_token_store
from tidemark.llm.url_rules import op1_url_filters


def _on(fn: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": _on(op1_url_filters, "pages", "labels"),
        "op2_sentencepiece": _on(op2_sentencepiece, "documents"),
        "op3_quality_rules": _on(op3_quality_rules, "documents", "labels"),
        "op4_best_fit_packing": _on(op4_best_fit_packing, "documents"),
        "op5_token_counts": _on(op5_token_counts, "documents"),
        "op6_language_id": _on(op6_language_id, "documents"),
        "op7_near_dedup": _on(op7_near_dedup, "documents"),
        "op8_token_store": _on(op8_token_store, "documents"),
        "op9_fingerprints": _on(op9_fingerprints, "documents"),
        "op10_suffix_dedup": _on(op10_suffix_dedup, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    """op7's links and components are the only part that SQL computes whole in bearable time."""
    return {"op7_near_dedup": NEAR_DEDUP_SQL}


#: Exact links between shingle sets, then the least document reachable.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT a AS doc_id, a AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id,
       coalesce(l.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""
