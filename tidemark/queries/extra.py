"""Summaries, membership, JSON ingestion, lookups and a whole comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.engine import preflight
from tidemark.operators.quality import set_issues
from tidemark.plans.contracts import DatasetSpec, FieldSpec, Plan, RelationSpec
from tidemark.queries.base import cents, money, table
from tidemark.sources.ingest import ingest_json, lookup_choices


def customer_summary(spark, d):
    """Counts from tables aggregated before they are joined."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_filled"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    lines = li.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("k").agg(F.sum("n").alias("n_lines"))
    c = table(spark, d, "customer").select("c_custkey")
    out = c.join(o, c.c_custkey == o.o_custkey, "left").join(lines, F.col("c_custkey") == F.col("k"), "left")
    return out.select("c_custkey", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("n_orders", "n_filled", "n_lines")])


CUSTOMER_SUMMARY = """
SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_filled, 0) AS n_filled, coalesce(n_lines, 0) AS n_lines FROM customer
LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'F') AS n_filled FROM orders GROUP BY 1) a ON a.k = c_custkey
LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) b ON b.k = c_custkey
"""


def filtered_counts(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("n_large"), F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("n_pairs"), F.count_distinct("l_orderkey").alias("n_orders"))


FILTERED_COUNTS = "SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS n_large, count(DISTINCT {'a': l_partkey, 'b': l_suppkey}) AS n_pairs, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1"


def membership(spark, d):
    """Semi and anti joins: customers with orders, and orders that no line belongs to."""
    o = table(spark, d, "orders")
    have = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.lit("customer with orders").alias("kind"), F.col("c_custkey").alias("id"))
    lost = o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("order without lines").alias("kind"), F.col("o_orderkey").alias("id"))
    return have.unionByName(lost)


MEMBERSHIP = """
SELECT 'customer with orders' AS kind, c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'order without lines', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
"""


def json_ingest(spark, d):
    return ingest_json(table(spark, d, "events").select("event_id", "event_type", "props"), "props", "k bigint")


JSON_INGEST = "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


def lookup_snapshot(spark, d):
    return lookup_choices(table(spark, d, "part"), "p_name", "p_brand")


LOOKUP_SNAPSHOT = "SELECT p_name AS label, count(DISTINCT p_brand) AS n_values, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS value, count(DISTINCT p_brand) > 1 AS ambiguous FROM part GROUP BY 1"


def default_statuses(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return set_issues(o, ["o_orderkey"], o.filter("o_orderkey % 50 = 0").select("o_orderkey", F.lit("BLOCKED").alias("status")), F.lit("ELIGIBLE"))


DEFAULT_STATUSES = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN 'BLOCKED' ELSE 'ELIGIBLE' END AS status FROM orders"

PLAN = Plan((
    DatasetSpec("customers", ("code",), (FieldSpec("code", source="code", kind="integer", required=True), FieldSpec("segment", source="segment", case="lower"), FieldSpec("balance", source="balance", kind="decimal", places=2))),
    DatasetSpec(
        "orders", ("number",),
        (FieldSpec("number", source="number", kind="integer", required=True), FieldSpec("customer", source="customer", kind="integer", required=True), FieldSpec("status", source="status"), FieldSpec("day", source="day", kind="date", form="dmy_slash")),
        relations=(RelationSpec("customer", "customers", ("customer",)),),
    ),
))


def whole_comparison(spark, d):
    """Two related datasets from text to decisions: bad cells, missing parents, duplicates, ambiguous and changed rows."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    ck, ok = F.col("c_custkey"), F.col("o_orderkey")
    sources = {
        "customers": c.filter(ck % 10 != 9).select(ck.alias("src_row"), F.concat(F.lit(" "), F.when(ck % 17 == 3, "x").otherwise(ck.cast("string"))).alias("code"), F.upper("c_mktsegment").alias("segment"), money(cents("c_acctbal")).alias("balance")),
        "orders": o.select(ok.alias("src_row"), ok.cast("string").alias("number"), F.col("o_custkey").cast("string").alias("customer"), F.concat(F.col("o_orderstatus"), F.lit(" ")).alias("status"), F.date_format("o_orderdate", "d/M/yyyy").alias("day")).union(o.filter(ok % 200 == 77).select(-ok, ok.cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.date_format("o_orderdate", "d/M/yyyy"))),
    }
    number = "decimal(38,0)"
    targets = {
        "customers": c.filter(ck % 4 != 1).select(ck.cast(number).alias("code"), F.lower("c_mktsegment").alias("segment"), ((cents("c_acctbal") + F.when(ck % 6 == 0, 5).otherwise(0)).cast("decimal(20,0)") / 100).cast("decimal(38,2)").alias("balance")),
        "orders": o.filter(ok % 7 != 2).select(ok.cast(number).alias("number"), F.col("o_custkey").cast(number).alias("customer"), F.when(ok % 5 == 4, "Z").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").cast("date").alias("day"), F.explode(F.array_repeat(F.lit(1), F.when(ok % 23 == 5, 2).otherwise(1))).alias("n")).drop("n"),
    }
    out = preflight(PLAN, sources, targets).decisions
    return out["customers"].select("dataset", "src_row", "classification").unionByName(out["orders"].select("dataset", "src_row", "classification"))


WHOLE_COMPARISON = """
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 17 = 3 THEN 'BLOCKED' WHEN c_custkey % 4 = 1 THEN 'CREATE' WHEN c_custkey % 6 = 0 THEN 'UPDATE' ELSE 'UNCHANGED' END AS class FROM customer WHERE c_custkey % 10 <> 9),
o AS (SELECT o_orderkey AS r, o_orderkey, o_custkey FROM orders UNION ALL SELECT -o_orderkey, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 200 = 77)
SELECT 'customers' AS dataset, k AS src_row, class AS classification FROM c
UNION ALL SELECT 'orders', r, CASE WHEN o_orderkey % 200 = 77 OR c.k IS NULL OR c.class = 'BLOCKED' THEN 'BLOCKED' WHEN o_orderkey % 7 = 2 THEN 'CREATE' WHEN o_orderkey % 23 = 5 THEN 'AMBIGUOUS' WHEN o_orderkey % 5 = 4 THEN 'UPDATE' ELSE 'UNCHANGED' END
FROM o LEFT JOIN c ON c.k = o_custkey
"""

QUERIES = {
    "customer_summary": (customer_summary, CUSTOMER_SUMMARY),
    "filtered_counts": (filtered_counts, FILTERED_COUNTS),
    "membership": (membership, MEMBERSHIP),
    "json_ingest": (json_ingest, JSON_INGEST),
    "lookup_snapshot": (lookup_snapshot, LOOKUP_SNAPSHOT),
    "default_statuses": (default_statuses, DEFAULT_STATUSES),
    "whole_comparison": (whole_comparison, WHOLE_COMPARISON),
}
