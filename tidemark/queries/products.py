"""Preparation of a wide table end to end: 20 fields, issues, duplicate identities, dispositions and the change ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import identity, normalize, quality
from tidemark.plans.compile import prepare
from tidemark.plans.contracts import Check, Condition, DatasetSpec, FieldSpec, QualityRule, Rule, TextStep
from tidemark.operators.reshape import spread
from tidemark.queries.base import cents, money, sql_cents, table
from tidemark.sources.snapshot import work_table

SPEC = DatasetSpec(
    "products", ("order", "line", "part"),
    (
        FieldSpec("order", source="order", kind="integer", required=True),
        FieldSpec("line", source="line", kind="integer", required=True),
        FieldSpec("part", source="part", kind="integer", required=True),
        FieldSpec("supplier", source="supplier", kind="integer"),
        FieldSpec("flag", source="flag", case="lower", required=True),
        FieldSpec("status", source="status", value_map=(("F", "filled"), ("O", "open"))),
        FieldSpec("price", source="price", kind="decimal", places=1),
        FieldSpec("quantity", source="quantity", kind="integer", required=True),
        FieldSpec("discount", source="discount", kind="decimal", locale="de_DE"),
        FieldSpec("tax", source="tax", kind="decimal"),
        FieldSpec("ship", source="ship", kind="date", form="dmy_slash"),
        FieldSpec("state", provider="selection", rules=(Rule((Condition("quantity", "ge", "30", "integer"),), "bulk"), Rule((Condition("flag", "equals", "R"),), "returned")), otherwise="plain"),
        FieldSpec("code", provider="formula", formula="concat(flag, '-', quantity)", steps=(TextStep("literal", " ", ""),)),
        FieldSpec("kind", provider="constant", constant="line"),
        FieldSpec("title", source="title", squeeze=True, case="title"),
        FieldSpec("note", provider="fallback", source="note", constant="none"),
        FieldSpec("key", source="key", checks=(Check("exact_length", n=10), Check("characters", "digits", 8, "last"))),
        FieldSpec("short", source="key", steps=(TextStep("prefix", "K-", ""),)),
        FieldSpec("clean", source="title", steps=(TextStep("pattern", "[^A-Za-z0-9]+", "_"),)),
        FieldSpec("taxed", source="tax", kind="boolean"),  # never one: an issue in every row
    ),
)
RULES = (QualityRule("BUSINESS_UNEQUAL", "unequal", ("flag", "state"), "warning"), QualityRule("BUSINESS_REQUIRED_IF", "required_if", ("note", "ship"), "block"), QualityRule("BUSINESS_LARGE", "ordered", ("quantity", "limit"), "quarantine"))


def _source(spark, d):
    li = table(spark, d, "lineitem")
    key = F.lpad(F.col("l_orderkey").cast("string"), 8, "0")
    return li.select(
        F.col("l_orderkey").cast("string").alias("order"), F.col("l_linenumber").cast("string").alias("line"), F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("part"),
        F.col("l_suppkey").cast("string").alias("supplier"), F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" ")).alias("flag"), F.col("l_linestatus").alias("status"),
        money(cents("l_extendedprice")).alias("price"), F.col("l_quantity").cast("bigint").cast("string").alias("quantity"), F.translate(money(cents("l_discount")), ".", ",").alias("discount"),
        money(cents("l_tax")).alias("tax"), F.date_format("l_shipdate", "d/M/yyyy").alias("ship"), F.concat(F.lit("item  "), F.lower("l_returnflag"), F.lit(" x"), F.col("l_linenumber").cast("string")).alias("title"),
        F.when(F.col("l_orderkey") % 3 == 0, " ").otherwise("noted").alias("note"), F.when(F.col("l_orderkey") % 40 == 0, F.lit("K-1")).otherwise(F.concat(F.lit("K-"), key)).alias("key"),
    )


def products_preparation(spark, d):
    """One row of totals over the prepared table, which is written whole, with all its values, texts and issues, and read back."""
    stored = work_table(prepare(spread(_source(spark, d)), SPEC), "products")
    rows = stored.withColumn("limit", F.lit(49).cast("decimal(38,0)"))
    sized = identity.with_group_size(rows, ["order", "line", "part"])
    base = F.when(F.exists("issues", lambda i: i["error"] == "SOURCE_REQUIRED_VALUE_MISSING") | (F.col("group_size") > 1), "BLOCKED").otherwise("ELIGIBLE")
    failed = [(r, F.coalesce(quality.fails(r), F.lit(False))) for r in RULES]
    worst = F.greatest(*[F.when(f, quality.SEVERITY[r.policy]).otherwise(0) for r, f in failed])
    changed = [normalize.outcome(F.col(f"{n}__text"), F.col(n).cast("string"), F.lit(None).cast("string"), F.lit(False)) for n in ("flag", "price", "ship", "title", "clean")]
    marked = sized.select(
        base.alias("base"), worst.alias("worst"), F.size("issues").alias("n_issues"), "group_size", "price", "quantity", "state", "note__fallback", "title", "clean", "short",
        sum(((c == "changed").cast("int") for c in changed), F.lit(0)).alias("n_changed"),
    )
    return marked.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_issues").alias("n_issues"), F.count_if(F.col("group_size") > 1).alias("n_duplicates"), F.count_if((F.col("base") == "BLOCKED") | (F.col("worst") == 3)).alias("n_blocked"),
        F.count_if((F.col("base") != "BLOCKED") & (F.col("worst") == 2)).alias("n_quarantined"), F.sum((F.col("price") * 10).cast("bigint")).alias("price_tenths"), F.sum(F.col("quantity").cast("bigint")).alias("quantity"),
        F.count_if(F.col("state") == "bulk").alias("n_bulk"), F.count_if("note__fallback").alias("n_fallback"), F.min("title").alias("first_title"), F.max("clean").alias("last_clean"), F.max("short").alias("last_short"), F.sum("n_changed").cast("bigint").alias("n_changed"),
    )


PRODUCTS = f"""
WITH s AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) AS g, {sql_cents('l_extendedprice')} AS c FROM lineitem)
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN l_orderkey % 40 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_issues,
  count(*) FILTER (g > 1) AS n_duplicates, count(*) FILTER (g > 1) AS n_blocked, count(*) FILTER (g = 1 AND l_quantity > 49) AS n_quarantined, CAST(sum((c + 5) // 10) AS BIGINT) AS price_tenths,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) FILTER (l_quantity >= 30) AS n_bulk, count(*) FILTER (l_orderkey % 3 = 0) AS n_fallback,
  min('Item ' || upper(l_returnflag) || ' X' || l_linenumber) AS first_title, max('item_' || lower(l_returnflag) || '_x' || l_linenumber) AS last_clean,
  max(CASE WHEN l_orderkey % 40 = 0 THEN '1' ELSE lpad(CAST(l_orderkey AS VARCHAR), 8, '0') END) AS last_short,
  2 * count(*) AS n_changed
FROM s
"""
QUERIES = {"products_preparation": (products_preparation, PRODUCTS)}
