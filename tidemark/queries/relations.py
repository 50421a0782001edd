"""Comparison, reshaping, relationship, quality, resolution, ledger and paging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.convert import canonical, parse_decimal
from tidemark.operators import compare, identity, normalize, paging, profile, quality, reconcile, relate, reshape, resolve
from tidemark.plans.contracts import QualityRule, ResolutionRule
from tidemark.queries.base import cents, money, sql_cents, table
from tidemark.queries.values import RULES
from tidemark.sources.paged import key_chunks

# ---------------------------------------------------------------- classification


def _decisions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", cents("o_totalprice").alias("c"))
    key = F.concat(F.lit("  K"), F.col("o_orderkey").cast("string"), F.lit(" "))
    source = o.select("o_orderkey", canonical(key, "string").alias("key"), canonical(F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.lower("o_orderstatus")), "string").alias("status"), parse_decimal(money(F.col("c")), scale=2).alias("price"))
    copies = F.when(F.col("o_orderkey") % 11 == 0, 2).when(F.col("o_orderkey") % 7 == 0, 0).otherwise(1)
    target = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("t_key"), F.lower("o_orderstatus").alias("t_status"), parse_decimal(money(F.col("c") + F.when(F.col("o_orderkey") % 5 == 0, 100).otherwise(0)), scale=2).alias("t_price"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).drop("copy")
    m = compare.matched(source, target, {"key": "t_key"}, ["id", "t_status", "t_price"])
    fields = [("status", F.col("status"), F.col("match.t_status"), "distinct"), ("price", F.col("price"), F.col("match.t_price"), "distinct")]
    m = m.withColumn("diffs", compare.differences(fields))
    return m.withColumn("classification", compare.classified(F.col("status").isNull(), F.col("n_matches"), F.size("diffs") > 0, F.lit(False)))


def classify_orders(spark, d):
    return _decisions(spark, d).select("o_orderkey", "n_matches", "classification")


_CLASS = """CASE WHEN o_orderkey % 13 = 0 THEN 'BLOCKED' WHEN o_orderkey % 11 = 0 THEN 'AMBIGUOUS' WHEN o_orderkey % 7 = 0 THEN 'CREATE'
  WHEN o_orderkey % 5 = 0 THEN 'UPDATE' ELSE 'UNCHANGED' END"""
CLASSIFY_ORDERS = f"""
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_matches, {_CLASS} AS classification FROM orders
"""


def class_counts(spark, d):
    return compare.class_counts(_decisions(spark, d)).withColumn("ready", compare.readiness(F.col("classification")))


CLASS_COUNTS = f"""
SELECT c.classification, CAST(count(o.classification) AS BIGINT) AS n_rows, CASE c.classification WHEN 'AMBIGUOUS' THEN 'needs_review' WHEN 'BLOCKED' THEN 'blocked' ELSE 'ready' END AS ready
FROM (SELECT unnest(['CREATE', 'UPDATE', 'UNCHANGED', 'AMBIGUOUS', 'BLOCKED']) AS classification) c
LEFT JOIN (SELECT {_CLASS} AS classification FROM orders) o USING (classification) GROUP BY c.classification
"""


def classify_ambiguous_lines(spark, d):
    li = table(spark, d, "lineitem")
    source = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("bigint")).alias("qty"))
    target = li.select(F.col("l_orderkey").alias("to"), F.col("l_linenumber").alias("tl"), F.col("l_quantity").cast("bigint").alias("tq"))
    m = compare.matched(source, target, {"l_orderkey": "to", "l_linenumber": "tl"}, ["tq"])
    return m.select("l_orderkey", "l_linenumber", compare.classified(F.lit(False), F.col("n_matches"), ~F.col("qty").eqNullSafe(F.col("match.tq")), F.lit(False)).alias("classification"))


CLASSIFY_LINES = "SELECT l_orderkey, l_linenumber, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS' ELSE 'UNCHANGED' END AS classification FROM lineitem GROUP BY ALL"


def field_diff_customers(spark, d):
    c = table(spark, d, "customer")
    s = F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).when(F.col("c_custkey") % 6 == 1, "").otherwise(F.col("c_mktsegment"))
    t = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    diffs = compare.differences([(p, s, t, p) for p in ("distinct", "equivalent", "ignore_source_null")])
    return c.select("c_custkey", F.explode(diffs).alias("x")).select("c_custkey", "x.field", "x.existing", "x.proposed")


FIELD_DIFF = """
SELECT c_custkey, field, t AS existing, s AS proposed
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN '' ELSE c_mktsegment END AS s, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS t FROM customer),
     (SELECT unnest(['distinct', 'equivalent', 'ignore_source_null']) AS field)
WHERE CASE field WHEN 'distinct' THEN s IS DISTINCT FROM t WHEN 'equivalent' THEN nullif(s, '') IS DISTINCT FROM nullif(t, '') ELSE s IS NOT NULL AND s IS DISTINCT FROM t END
"""


def _set_ops(op):
    def run(spark, d):
        p = table(spark, d, "part")
        existing, proposed = F.split("p_name", " "), F.array(F.lower("p_type"), F.element_at(F.split("p_name", " "), 1), F.lower("p_type"))
        change = compare.set_change(existing, proposed, op)
        return p.select("p_partkey", F.array_join(change["final"], ",").alias("final"), change["changed"].alias("changed"))

    return run


def _set_sql(final):
    return f"""
SELECT p_partkey, array_to_string(f, ',') AS final, f <> e AS changed
FROM (SELECT p_partkey, e, {final} AS f
      FROM (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS e, list_sort(list_distinct([lower(p_type), string_split(p_name, ' ')[1]])) AS p FROM part))
"""


def resolve_references(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 29 > 0, F.col("o_custkey")).alias("o_custkey"))
    c = table(spark, d, "customer")
    parents = c.filter("c_custkey % 4 <> 0").select("c_custkey", (F.col("c_acctbal") < 0).alias("blocked")).union(c.filter("c_custkey % 9 = 5").select("c_custkey", F.lit(False)))
    return compare.resolve_references(o, parents, {"o_custkey": "c_custkey"}, "blocked").select("o_orderkey", "reference")


RESOLVE_REFERENCES = """
SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'EMPTY' WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' WHEN b > 0 THEN 'BLOCKED_BY_DEPENDENCY' ELSE 'RESOLVED' END AS reference
FROM orders LEFT JOIN (
  SELECT k, count(*) AS n, max(b) AS b FROM (
    SELECT c_custkey AS k, CAST(c_acctbal < 0 AS INTEGER) AS b FROM customer WHERE c_custkey % 4 <> 0
    UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey % 9 = 5) GROUP BY k) ON k = o_custkey AND o_orderkey % 29 > 0
"""


def business_keys(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 31 == 0, -1).otherwise(F.col("o_custkey")).alias("cust"))
    c = table(spark, d, "customer")
    one = compare.id_to_key(o, "cust", c, "c_custkey", ["c_name", "c_nationkey"], "customer_key")
    n = table(spark, d, "nation")
    lists = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 1) % 30).alias("ids"))
    many = compare.ids_to_keys(lists, "o_orderkey", "ids", n, "n_nationkey", "n_name", "nations")
    joined = one.join(many.select("o_orderkey", F.array_join("nations", ",").alias("nations"), "nations_missing"), "o_orderkey", "left")
    return joined.select("o_orderkey", "customer_key", "customer_key_missing", "nations", "nations_missing")


BUSINESS_KEYS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE '["' || c_name || '","' || c_nationkey || '"]' END AS customer_key, o_orderkey % 31 = 0 AS customer_key_missing, m.nations, m.nations_missing
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT x.c_custkey AS k, array_to_string(list_sort(list(DISTINCT n_name) FILTER (n_name IS NOT NULL)), ',') AS nations, count(*) FILTER (n_name IS NULL) AS nations_missing
  FROM (SELECT DISTINCT c_custkey, unnest([c_nationkey, (c_nationkey + 1) % 30]) AS id FROM customer) x LEFT JOIN nation ON n_nationkey = id GROUP BY 1) m ON m.k = o_orderkey
"""


def issue_grouping(spark, d):
    li = table(spark, d, "lineitem")
    issues = li.filter("l_quantity >= 45").select(F.concat(F.lit("SOURCE_"), F.col("l_returnflag")).alias("code"), F.lit("too many").alias("message"), F.when(F.col("l_linestatus") == "F", "error").otherwise("warning").alias("severity"), F.lit("lines").alias("dataset"), F.concat(F.lit("f"), (F.col("l_orderkey") % 997).cast("string")).alias("field"), F.col("l_orderkey").alias("row"))
    return compare.grouped_issues(issues)


ISSUE_GROUPING = """
SELECT code, message, severity, dataset, field, count(DISTINCT row) AS affected, CASE WHEN count(DISTINCT row) = 1 THEN min(row) END AS row
FROM (SELECT 'SOURCE_' || l_returnflag AS code, 'too many' AS message, CASE WHEN l_linestatus = 'F' THEN 'error' ELSE 'warning' END AS severity, 'lines' AS dataset,
        'f' || CAST(l_orderkey % 997 AS VARCHAR) AS field, l_orderkey AS row FROM lineitem WHERE l_quantity >= 45)
GROUP BY code, message, severity, dataset, field
"""


def three_way_compare(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    prepared = F.when(k % 3 == 0, "X").otherwise(status)
    live = F.when(k % 5 == 0, "Y").when(k % 15 == 6, "X").otherwise(status)
    price_live = cents("o_totalprice") + F.when(k % 8 == 0, 1).otherwise(0)
    has = k % 17 != 0
    f1 = compare.pinned_field(prepared, status, live, has, F.lit(True))
    f2 = compare.pinned_field(cents("o_totalprice"), cents("o_totalprice"), price_live, has, k % 19 != 0, written=False)
    return o.select("o_orderkey", f1.alias("status_outcome"), f2.alias("price_outcome"), compare.pinned_row([f1, f2]).alias("row_outcome"))


THREE_WAY = """
SELECT o_orderkey, f1 AS status_outcome, f2 AS price_outcome,
  CASE WHEN 'SCHEMA_CHANGED' IN (f1, f2) THEN 'SCHEMA_CHANGED' WHEN 'BASELINE_MISSING' IN (f1, f2) THEN 'BASELINE_MISSING' WHEN 'CONCURRENT_CHANGE' IN (f1, f2) THEN 'CONCURRENT_CHANGE'
       WHEN 'UPDATE' IN (f1, f2) THEN 'UPDATE' WHEN 'EXTERNAL_CHANGE_NOT_WRITTEN' IN (f1, f2) THEN 'EXTERNAL_CHANGE_NOT_WRITTEN' ELSE 'UNCHANGED' END AS row_outcome
FROM (SELECT o_orderkey,
  CASE WHEN o_orderkey % 17 = 0 THEN 'BASELINE_MISSING' WHEN o_orderkey % 15 = 0 THEN 'CONCURRENT_CHANGE' WHEN o_orderkey % 5 = 0 THEN 'EXTERNAL_CHANGE_NOT_WRITTEN'
       WHEN o_orderkey % 15 = 6 THEN 'UNCHANGED' WHEN o_orderkey % 3 = 0 THEN 'UPDATE' ELSE 'UNCHANGED' END AS f1,
  CASE WHEN o_orderkey % 17 = 0 THEN 'BASELINE_MISSING' WHEN o_orderkey % 19 = 0 THEN 'SCHEMA_CHANGED' WHEN o_orderkey % 8 = 0 THEN 'EXTERNAL_CHANGE_NOT_WRITTEN' ELSE 'UNCHANGED' END AS f2
FROM orders)
"""


def write_intents(spark, d):
    m = _decisions(spark, d).withColumns({"t_status": F.col("match.t_status"), "t_cents": (F.col("match.t_price") * 100).cast("bigint"), "cents": (F.col("price") * 100).cast("bigint")})
    fields = [("status", F.col("status"), F.col("t_status")), ("price", F.col("cents"), F.col("t_cents"))]
    return compare.write_intents(m, ["o_orderkey"], fields, 3, ("status",)).withColumns({"phase": F.col("phase").cast("bigint"), "sequence": F.col("sequence").cast("bigint")})


WRITE_INTENTS = f"""
SELECT o_orderkey, classification, CAST(3 AS BIGINT) AS sequence, CAST(CASE field WHEN 'status' THEN 2 ELSE 1 END AS BIGINT) AS phase, field,
  CASE field WHEN 'status' THEN lower(o_orderstatus) ELSE CAST({sql_cents('o_totalprice')} AS VARCHAR) END AS value
FROM (SELECT *, {_CLASS} AS classification FROM orders), (SELECT unnest(['status', 'price']) AS field)
WHERE classification = 'CREATE' OR (classification = 'UPDATE' AND field = 'price')
"""


def reconcile_status(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    intents = o.select("o_orderkey", (k % 10 != 0).alias("attempted"), (k % 6 == 0).alias("uncertain"), F.lower("o_orderstatus").alias("value"), F.lit("old").alias("before"))
    back = o.filter("o_orderkey % 4 <> 0").select("o_orderkey", F.when(k % 3 == 0, "old").when(k % 7 == 0, "zzz").otherwise(F.lower("o_orderstatus")).alias("found"))
    return reconcile.outcomes(intents, back, ["o_orderkey"]).select("o_orderkey", "status")


RECONCILE_STATUS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'NOT_WRITTEN' WHEN o_orderkey % 6 = 0 AND o_orderkey % 4 = 0 THEN 'OUTCOME_UNKNOWN' WHEN o_orderkey % 4 = 0 THEN 'MISSING'
  WHEN o_orderkey % 3 = 0 THEN 'NOT_APPLIED' WHEN o_orderkey % 7 = 0 THEN 'DIFFERENT' ELSE 'VERIFIED' END AS status
FROM orders
"""


def reconcile_run(spark, d):
    return reconcile.run_status(reconcile_status(spark, d))


RECONCILE_RUN = "SELECT 'OUTCOME_UNKNOWN' AS run_status, count(*) AS n_rows FROM orders"


def read_requirements(spark, d):
    chunks = key_chunks(table(spark, d, "orders").select("o_custkey"), ["o_custkey"], 100)
    sizes = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("n_keys"), (F.max("n") <= 100).alias("all_bounded"))


READ_REQUIREMENTS = "SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_keys, TRUE AS all_bounded FROM orders"


# ---------------------------------------------------------------- reshaping


def exact_left_join_lineage(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").filter("c_custkey % 6 <> 0").select("c_custkey", "c_name", F.col("c_custkey").alias("c_row"))
    out, _ = reshape.exact_join(o.select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("o_row")), c, [("o_custkey", "c_custkey")], ["c_name", "c_row"])
    lines = reshape.lineage(out, "o_orderkey", {"orders": "o_row", "customer": "c_row"})
    return lines.join(out.select(F.col("o_orderkey").alias("out_row"), "c_name", "matched"), "out_row")


EXACT_JOIN = """
WITH j AS (SELECT o_orderkey AS out_row, c_name, c_custkey IS NOT NULL AS matched, c_custkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 6 <> 0) ON o_custkey = c_custkey)
SELECT out_row, 'orders' AS dataset, out_row AS src_row, c_name, matched FROM j UNION ALL SELECT out_row, 'customer', c_custkey, c_name, matched FROM j WHERE matched
"""


def join_reconciliation(spark, d):
    return reshape.reconcile_join(table(spark, d, "orders"), table(spark, d, "customer").filter("c_custkey % 6 <> 0"), [("o_custkey", "c_custkey")])


JOIN_RECONCILIATION = """
SELECT count(*) FILTER (o_custkey % 6 <> 0) AS left_matched, count(*) FILTER (o_custkey % 6 = 0) AS left_unmatched,
  (SELECT count(*) FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders)) AS right_matched,
  (SELECT count(*) FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)) AS right_unmatched
FROM orders
"""


def reference_lookup(spark, d):
    n = table(spark, d, "nation").withColumn("region", F.when(F.col("n_nationkey") % 5 == 0, F.lit(None)).otherwise(F.col("n_regionkey") + F.when(F.col("n_nationkey") == 7, 100).otherwise(0)))
    out, _ = reshape.exact_join(n.select("n_nationkey", "region"), table(spark, d, "region"), [("region", "r_regionkey")], ["r_name"])
    issue = F.when(F.col("region").isNull(), "REFERENCE_KEY_BLANK").when(~F.col("matched"), "REFERENCE_KEY_UNKNOWN")
    return out.select("n_nationkey", "r_name", issue.alias("issue"))


REFERENCE_LOOKUP = """
SELECT n_nationkey, r_name, CASE WHEN n_nationkey % 5 = 0 THEN 'REFERENCE_KEY_BLANK' WHEN r_name IS NULL THEN 'REFERENCE_KEY_UNKNOWN' END AS issue
FROM nation LEFT JOIN region ON r_regionkey = CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey + CASE WHEN n_nationkey = 7 THEN 100 ELSE 0 END END
"""


def union_all_accounting(spark, d):
    u = reshape.union_all([("customer", table(spark, d, "customer"), {"name": "c_name", "nation": "c_nationkey"}), ("supplier", table(spark, d, "supplier"), {"name": "s_name", "nation": "s_nationkey"})])
    return u.groupBy("branch", "nation").agg(F.count(F.lit(1)).alias("n_rows"), F.min("name").alias("first_name"))


UNION_ALL = """
SELECT branch, nation, count(*) AS n_rows, min(name) AS first_name FROM (
  SELECT 'customer' AS branch, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey FROM supplier) GROUP BY ALL
"""


def group_count_sum(spark, d):
    out, _ = reshape.group_rows(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"cents": cents("l_extendedprice"), "qty": F.col("l_quantity").cast("bigint")})
    return out


GROUP_COUNT = f"SELECT l_returnflag, l_linestatus, count(*) AS row_count, CAST(sum({sql_cents('l_extendedprice')}) AS BIGINT) AS cents, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY ALL"


def parent_child_split(spark, d):
    p = table(spark, d, "part")
    key = F.when(F.col("p_partkey") % 40 == 0, " ").otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))))
    return reshape.parent_split(p, key, "p_partkey", ["p_brand", "p_type"])


PARENT_SPLIT = """
SELECT CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_name END AS parent_key, min(p_partkey) AS p_partkey, count(*) AS n_rows, arg_min(p_brand, p_partkey) AS p_brand, arg_min(p_type, p_partkey) AS p_type
FROM part GROUP BY CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_name END, CASE WHEN p_partkey % 40 = 0 THEN p_partkey END
"""


def split_preview(spark, d):
    p = table(spark, d, "part")
    return reshape.split_preview(p, F.when(F.col("p_partkey") % 40 == 0, "").otherwise(F.concat(F.lit(" "), F.col("p_brand"))), F.col("p_type"))


SPLIT_PREVIEW = """
WITH v AS (SELECT CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_brand END AS k, p_type AS c, count(*) AS n FROM part GROUP BY ALL)
SELECT CAST(count(DISTINCT k) AS BIGINT) AS n_groups, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS n_blank, CAST(coalesce(sum(n) FILTER (k IS NOT NULL), 0) AS BIGINT) AS n_normalised,
  count(*) FILTER (k IS NOT NULL AND n > 1) AS n_repeated_children FROM v
"""


def derived_hierarchy(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), F.lit("/ "), F.col("p_type"), F.when(F.col("p_partkey") % 50 == 0, "//").otherwise(F.concat(F.lit("/"), F.element_at(F.split("p_name", " "), 1))))
    return reshape.derived_hierarchy(p, path, "p_partkey")


DERIVED_HIERARCHY = """
WITH base AS (SELECT p_partkey AS r, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS a, p_type AS b, string_split(p_name, ' ')[1] AS c FROM part WHERE p_partkey % 50 <> 0),
each AS (SELECT r, 1 AS depth, a AS name, NULL AS above FROM base UNION ALL SELECT r, 2, a || ' / ' || b, lower(a) FROM base UNION ALL SELECT r, 3, a || ' / ' || b || ' / ' || c, lower(a || ' / ' || b) FROM base)
SELECT CAST(depth AS BIGINT) AS depth, lower(name) AS key, arg_min(name, r) AS display_name, count(DISTINCT name) AS n_aliases, count(DISTINCT r) AS n_rows, min(r) AS first_row, any_value(above) AS parent_key,
  CASE WHEN count(DISTINCT name) > 1 THEN 'DERIVED_ALIAS_REVIEW_REQUIRED' END AS issue
FROM each GROUP BY depth, lower(name)
"""


def derived_references(spark, d):
    p = table(spark, d, "part")
    path = F.when(F.col("p_partkey") % 9 == 0, " ").when(F.col("p_partkey") % 9 == 1, "a//b").otherwise(F.concat(F.col("p_brand"), F.lit(" / "), F.col("p_type")))
    ref = reshape.derived_reference(path)
    return p.select("p_partkey", ref["key"].alias("key"), ref["issue"].alias("issue"))


DERIVED_REFERENCES = """
SELECT p_partkey, CASE WHEN p_partkey % 9 > 1 THEN lower(p_brand || ' / ' || p_type) END AS key,
  CASE p_partkey % 9 WHEN 0 THEN 'DERIVED_REFERENCE_MISSING' WHEN 1 THEN 'DERIVED_REFERENCE_QUARANTINED' END AS issue FROM part
"""


def impact_ledger(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.col("p_name")).alias("raw_name"), F.upper("p_name").alias("name"), F.col("p_type").alias("raw_type"), F.upper("p_type").alias("type"), F.col("p_brand").alias("raw_brand"), F.lower("p_brand").alias("brand"))
    return reshape.unpivot_changes(p, ["p_partkey"], [("name", "raw_name", "name"), ("type", "raw_type", "type"), ("brand", "raw_brand", "brand")])


IMPACT_LEDGER = """
SELECT p_partkey, 'name' AS field, ' ' || p_name AS raw, upper(p_name) AS proposed FROM part
UNION ALL SELECT p_partkey, 'brand', p_brand, lower(p_brand) FROM part WHERE p_brand <> lower(p_brand) UNION ALL SELECT p_partkey, 'type', p_type, upper(p_type) FROM part WHERE p_type <> upper(p_type)
"""


def normalization_groups(spark, d):
    ledger = impact_ledger(spark, d).withColumn("eligible", F.col("p_partkey") % 4 != 0)
    return normalize.normalization_groups(ledger, ["field", "proposed"], "p_partkey", 5)


NORMALIZATION_GROUPS = f"""
WITH l AS (SELECT *, p_partkey % 4 <> 0 AS eligible FROM ({IMPACT_LEDGER}))
SELECT field, proposed, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (NOT eligible) AS n_set_aside,
  array_to_string(list_slice(list(raw ORDER BY p_partkey) FILTER (eligible), 1, 5), ' | ') AS examples
FROM l GROUP BY field, proposed
"""


def rule_impacts(spark, d):
    c = table(spark, d, "customer").withColumn("c_acctbal", money(cents("c_acctbal")))
    return normalize.rule_impacts(c, RULES).withColumn("rule_no", F.col("rule_no").cast("bigint"))


RULE_IMPACTS = f"""
WITH r AS (SELECT b < 0 AS r1, lower(c_mktsegment) = 'machinery' AND b >= 500000 AS r2, starts_with(c_mktsegment, 'AUTO') OR c_name LIKE '%7' AS r3, c_nationkey <= 3 AS r4
  FROM (SELECT *, {sql_cents('c_acctbal')} AS b FROM customer)),
x AS (SELECT unnest([{{'rule_no': 1, 'hit': r1, 'won': r1}}, {{'rule_no': 2, 'hit': r2, 'won': r2 AND NOT r1}}, {{'rule_no': 3, 'hit': r3, 'won': r3 AND NOT (r1 OR r2)}}, {{'rule_no': 4, 'hit': r4, 'won': r4 AND NOT (r1 OR r2 OR r3)}}]) AS s,
  CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER) + CAST(r3 AS INTEGER) + CAST(r4 AS INTEGER) AS n FROM r)
SELECT CAST(s.rule_no AS BIGINT) AS rule_no, count(*) AS evaluated, count(*) FILTER (s.hit) AS matched, count(*) FILTER (s.won) AS selected, count(*) FILTER (s.hit AND n > 1) AS overlapping FROM x GROUP BY s.rule_no
"""


def outcome_counts(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    out = normalize.outcome(F.col("p_name"), F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.when(k % 11 == 0, "E"), k % 7 == 0)
    counted = normalize.outcome_counts(p.select("p_brand", out.alias("outcome")), ["p_brand"])
    kinds = p.select("p_brand", F.when(k % 2 == 0, "case").otherwise("space").alias("kind")).groupBy("p_brand").agg(F.max("kind").alias("kind"))
    return counted.join(normalize.review_policy(kinds, {"case": "AUTOMATIC"}).select("p_brand", "review"), "p_brand")


OUTCOME_COUNTS = """
SELECT p_brand, count(*) FILTER (o = 'invalid') AS n_invalid, count(*) FILTER (o = 'fallback') AS n_fallback, CAST(0 AS BIGINT) AS n_provided, count(*) FILTER (o = 'null') AS n_null,
  count(*) FILTER (o = 'changed') AS n_changed, count(*) FILTER (o = 'unchanged') AS n_unchanged, CASE WHEN max(CASE WHEN p_partkey % 2 = 0 THEN 'case' ELSE 'space' END) = 'case' THEN 'AUTOMATIC' ELSE 'DECISION_REQUIRED' END AS review
FROM (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'invalid' WHEN p_partkey % 7 = 0 THEN 'fallback' WHEN p_partkey % 5 = 0 THEN 'null' WHEN p_partkey % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS o FROM part) GROUP BY p_brand
"""


def top5_examples(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", cents("l_extendedprice").alias("cents")).distinct()
    return resolve.top_per_group(li, ["l_returnflag", "l_linestatus"], ["cents"], 5)


TOP5 = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY cents) AS rank_in_group
FROM (SELECT DISTINCT l_returnflag, l_linestatus, {sql_cents('l_extendedprice')} AS cents FROM lineitem)) WHERE rank_in_group <= 5
"""

# ---------------------------------------------------------------- identity, order, profile


def duplicate_identities(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return identity.duplicate_identities(li, ["l_orderkey", "l_linenumber"])


DUPLICATES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, group_size, 'SOURCE_IDENTITY_DUPLICATE' AS issue
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS group_size FROM lineitem) WHERE group_size > 1
"""


def identity_collisions(spark, d):
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.upper("p_name"))
    return identity.identity_collisions(p, [name, F.col("p_brand")], "p_partkey")


COLLISIONS = """
SELECT p_partkey, identity, group_size, 'POST_TRANSFORM_IDENTITY_COLLISION' AS issue FROM (
  SELECT p_partkey, '["' || upper(p_name) || '","' || p_brand || '"]' AS identity, count(*) OVER (PARTITION BY p_name, p_brand) AS group_size FROM part WHERE p_partkey % 10 <> 0) WHERE group_size > 1
"""


def order_check_lag(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") - F.when(F.col("o_orderkey") % 1000 == 7, 3).otherwise(0)).alias("row")).filter("ordinal % 2500 <> 99")
    return identity.order_faults(o, "ordinal", ["row"], bucket=4096)


ORDER_CHECK = """
SELECT ordinal, gap, falls FROM (
  SELECT ordinal, coalesce(po <> ordinal - 1, ordinal <> 0) AS gap, coalesce(pr > r, FALSE) AS falls FROM (
    SELECT ordinal, r, lag(ordinal) OVER (ORDER BY ordinal) AS po, lag(r) OVER (ORDER BY ordinal) AS pr FROM (
      SELECT o_orderkey AS ordinal, o_orderkey - CASE WHEN o_orderkey % 1000 = 7 THEN 3 ELSE 0 END AS r FROM orders WHERE o_orderkey % 2500 <> 99))) WHERE gap OR falls
"""


def row_ordinals(spark, d):
    return reshape.ordinals(table(spark, d, "orders").select("o_orderkey", cents("o_totalprice").alias("cents")), ["cents", "o_orderkey"])


ROW_ORDINALS = f"SELECT o_orderkey, c AS cents, row_number() OVER (ORDER BY c, o_orderkey) - 1 AS ordinal FROM (SELECT o_orderkey, {sql_cents('o_totalprice')} AS c FROM orders)"


def artifact_integrity(spark, d):
    return identity.integrity(table(spark, d, "orders"), "o_orderkey")


ARTIFACT_INTEGRITY = """
SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey IS NULL) AS n_null, count(DISTINCT o_orderkey) AS n_distinct, min(o_orderkey) AS first, max(o_orderkey) AS last,
  count(DISTINCT o_orderkey) = count(*) AND min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AS contiguous FROM orders
"""


def column_profile(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 8 > 0, F.col("c_name")).otherwise(" ").alias("c_name"), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(".5"))).alias("number"), F.concat(F.lit("2024-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")).alias("day"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("padded"))
    return profile.profile(c)


COLUMN_PROFILE = """
WITH v AS (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 8 > 0 THEN c_name ELSE ' ' END AS c_name, c_mktsegment,
    CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE c_nationkey || '.5' END AS number, '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS day, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded FROM customer),
l AS (UNPIVOT v ON c_custkey, c_name, c_mktsegment, number, day, padded INTO NAME column_name VALUE x)
SELECT column_name, count(*) FILTER (trim(x) = '') AS null_count, count(*) FILTER (trim(x) <> '') AS non_null_count, count(DISTINCT x) FILTER (trim(x) <> '') AS distinct_count,
  min(length(x)) FILTER (trim(x) <> '') AS min_length, max(length(x)) FILTER (trim(x) <> '') AS max_length, min(x) FILTER (trim(x) <> '') AS min_text, max(x) FILTER (trim(x) <> '') AS max_text,
  CASE column_name WHEN 'c_custkey' THEN 'integer' WHEN 'number' THEN 'decimal' WHEN 'day' THEN 'date' ELSE 'string' END AS candidate_type,
  count(*) FILTER (trim(x) <> '') - count(DISTINCT x) FILTER (trim(x) <> '') AS duplicate_count
FROM l GROUP BY column_name
"""


def value_choices(spark, d):
    return profile.choices(table(spark, d, "orders").withColumn("p", F.concat(F.lit(" "), F.col("o_orderpriority"))), "p")


VALUE_CHOICES = "SELECT o_orderpriority AS value, count(*) AS n_rows FROM orders GROUP BY 1"


def choice_tuples(spark, d):
    return profile.choice_tuples(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


CHOICE_TUPLES = "SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows FROM orders GROUP BY ALL"


def uncovered_categories(spark, d):
    found = profile.choices(table(spark, d, "customer"), "c_mktsegment")
    return profile.uncovered(found, spark.createDataFrame([("MACHINERY",), ("BUILDING",)], "value string"))


UNCOVERED = "SELECT c_mktsegment AS value, count(*) AS n_rows FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING') GROUP BY 1"

# ---------------------------------------------------------------- relationships and quality


def relationship_states(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, d, "orders").filter("o_orderkey % 8 <> 3")
    parents = o.select("o_orderkey", (F.col("o_orderstatus") == "P").alias("unsafe")).union(o.filter("o_orderkey % 10 = 1").select("o_orderkey", F.lit(False)))
    return relate.relationship_states(li, parents, "l_orderkey", "o_orderkey", "unsafe").groupBy("l_orderkey", "match_state", "resolution").agg(F.count(F.lit(1)).alias("n_lines"))


RELATIONSHIP_STATES = """
SELECT l_orderkey, CASE WHEN n IS NULL THEN 'MISSING' WHEN n = 1 THEN 'UNIQUE' ELSE 'DUPLICATE' END AS match_state,
  CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'AMBIGUOUS' WHEN u > 0 THEN 'UNSAFE_PARENT' ELSE 'RESOLVED' END AS resolution, count(*) AS n_lines
FROM lineitem LEFT JOIN (SELECT k, count(*) AS n, max(u) AS u FROM (
  SELECT o_orderkey AS k, CAST(o_orderstatus = 'P' AS INTEGER) AS u FROM orders WHERE o_orderkey % 8 <> 3 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 8 <> 3 AND o_orderkey % 10 = 1) GROUP BY k) ON k = l_orderkey
GROUP BY ALL
"""


def unsafe_propagation(spark, d):
    tables = {
        "nation": table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 6 == 0).alias("unsafe")),
        "customer": table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") < 0).alias("unsafe")),
        "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(False).alias("unsafe")),
        "lineitem": table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 49).alias("unsafe")),
    }
    relations = {"customer": [("nation", "c_nationkey", "n_nationkey")], "orders": [("customer", "o_custkey", "c_custkey")], "lineitem": [("orders", "l_orderkey", "o_orderkey")]}
    out = relate.propagate_levels(["nation", "customer", "orders", "lineitem"], tables, relations)["lineitem"]
    return out.groupBy("l_orderkey").agg(F.count_if("unsafe").alias("n_unsafe"), F.count(F.lit(1)).alias("n_lines"))


UNSAFE = """
SELECT l_orderkey, count(*) FILTER (l_quantity > 49 OR c_acctbal < 0 OR c_nationkey % 6 = 0) AS n_unsafe, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY l_orderkey
"""


def unsafe_chain(spark, d):
    """Self-referencing rows in chains of 64, by pointer doubling."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 64 > 0, F.col("o_orderkey") - 1).alias("parent"), (F.col("o_orderkey") % 97 == 5).alias("unsafe"))
    return relate.propagate_single_parent(o, "o_orderkey", "parent")


UNSAFE_CHAIN = """
SELECT o_orderkey, coalesce(bool_or(o_orderkey % 97 = 5) OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), FALSE) AS unsafe FROM orders
"""


def unsafe_closure(spark, d):
    """Reachability with cycles, by frontier."""
    n = table(spark, d, "nation")
    edges = n.select(F.col("n_nationkey").alias("parent"), ((F.col("n_nationkey") * 7 + 1) % 25).alias("child")).union(n.select("n_nationkey", ((F.col("n_nationkey") + 5) % 25)))
    return relate.closure(n.filter("n_nationkey = 3").select(F.col("n_nationkey").alias("node")), edges)


UNSAFE_CLOSURE = """
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation),
r AS (SELECT 3 AS node UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT node FROM r
"""

QUALITY = (
    QualityRule("BUSINESS_REQUIRED_IF", "required_if", ("flag", "note"), "quarantine", (("equals", "R"),)),
    QualityRule("BUSINESS_ONE_OF", "exactly_one_of", ("flag", "note"), "exclude"),
    QualityRule("BUSINESS_ORDERED", "ordered", ("qty", "price"), "block"),
    QualityRule("BUSINESS_UNEQUAL", "unequal", ("flag", "status"), "warning"),
)


def _quality_rows(spark, d):
    li = table(spark, d, "lineitem")
    # one row per line key
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")).alias("m"))
    return one.select("l_orderkey", "l_linenumber", F.col("m.l_returnflag").alias("flag"), F.when(F.col("l_orderkey") % 4 == 0, F.lit("x")).when(F.col("l_orderkey") % 4 == 1, F.lit("")).alias("note"), F.col("m.l_linestatus").alias("status"), F.col("m.l_quantity").alias("qty"), (F.col("l_orderkey") % 60).cast("double").alias("price"))


_QUALITY_BASE = """(SELECT l_orderkey, l_linenumber, m.l_returnflag AS flag, CASE WHEN l_orderkey % 4 = 0 THEN 'x' END AS note, m.l_linestatus AS status, m.l_quantity AS qty, CAST(l_orderkey % 60 AS DOUBLE) AS price
  FROM (SELECT l_orderkey, l_linenumber, min({'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_returnflag': l_returnflag, 'l_linestatus': l_linestatus, 'l_quantity': l_quantity}) AS m FROM lineitem GROUP BY 1, 2))"""


def quality_issues(spark, d):
    rows = _quality_rows(spark, d)
    return quality.row_issues(rows, ["l_orderkey", "l_linenumber"], QUALITY).withColumn("family", quality.family(F.col("code")))


QUALITY_ISSUES = f"""
SELECT l_orderkey, l_linenumber, code, policy, CASE code WHEN 'BUSINESS_REQUIRED_IF' THEN 'completeness' ELSE 'business' END AS family FROM (
  SELECT l_orderkey, l_linenumber, unnest([
    CASE WHEN flag = 'R' AND note IS NULL THEN {{'code': 'BUSINESS_REQUIRED_IF', 'policy': 'quarantine'}} END, CASE WHEN note IS NOT NULL THEN {{'code': 'BUSINESS_ONE_OF', 'policy': 'exclude'}} END,
    CASE WHEN qty > price THEN {{'code': 'BUSINESS_ORDERED', 'policy': 'block'}} END, CASE WHEN flag = status THEN {{'code': 'BUSINESS_UNEQUAL', 'policy': 'warning'}} END], recursive := TRUE) FROM {_QUALITY_BASE})
WHERE code IS NOT NULL
"""


def quality_dispositions(spark, d):
    return quality.dispositions(_quality_rows(spark, d), ["l_orderkey", "l_linenumber"], QUALITY, F.when(F.col("l_orderkey") % 101 == 0, "BLOCKED").otherwise("ELIGIBLE"))


QUALITY_DISPOSITIONS = f"""
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 101 = 0 OR qty > price THEN 'BLOCKED' WHEN flag = 'R' AND note IS NULL THEN 'QUARANTINED' WHEN note IS NOT NULL THEN 'EXCLUDED' ELSE 'ELIGIBLE' END AS disposition,
  CAST(flag = 'R' AND note IS NULL AS BIGINT) + CAST(note IS NOT NULL AS BIGINT) + CAST(qty > price AS BIGINT) + CAST(flag = status AS BIGINT) AS n_issues,
  array_to_string(list_filter([CASE WHEN note IS NOT NULL THEN 'BUSINESS_ONE_OF' END, CASE WHEN qty > price THEN 'BUSINESS_ORDERED' END, CASE WHEN flag = 'R' AND note IS NULL THEN 'BUSINESS_REQUIRED_IF' END, CASE WHEN flag = status THEN 'BUSINESS_UNEQUAL' END], lambda x: x IS NOT NULL), ',') AS codes
FROM {_QUALITY_BASE}
"""


def quarantine_entries(spark, d):
    rows, key = _quality_rows(spark, d), ["l_orderkey", "l_linenumber"]
    return quality.quarantine_entries(quality.dispositions(rows, key, QUALITY), quality.row_issues(rows, key, QUALITY), key)


QUARANTINE = f"SELECT l_orderkey, l_linenumber, 'BUSINESS_REQUIRED_IF' AS code, 'quarantine' AS policy FROM {_QUALITY_BASE} WHERE flag = 'R' AND note IS NULL AND NOT qty > price"


def metric_boundaries(spark, d):
    m = quality.metrics(table(spark, d, "customer").select(F.when(F.col("c_custkey") % 20 > 0, cents("c_acctbal")).alias("v")), "v")
    return quality.metric_boundaries(m, (("n_rows", 1, None), ("null_rate", None, 0.01), ("minimum", -50_000, None), ("n_distinct", None, 10), ("total", 0, None)))


METRICS = f"""
WITH m AS (SELECT count(*) AS n_rows, count(DISTINCT v) AS n_distinct, count(*) FILTER (v IS NULL) / count(*) AS null_rate, min(v) AS minimum, sum(v) AS total FROM (SELECT CASE WHEN c_custkey % 20 > 0 THEN {sql_cents('c_acctbal')} END AS v FROM customer))
SELECT 'n_rows' AS metric, CAST(n_rows AS DOUBLE) AS value, CASE WHEN n_rows < 1 THEN 'METRIC_BOUNDARY_FAILED' END AS issue FROM m
UNION ALL SELECT 'null_rate', CAST(null_rate AS DOUBLE), CASE WHEN null_rate > 0.01 THEN 'METRIC_BOUNDARY_FAILED' END FROM m
UNION ALL SELECT 'minimum', CAST(minimum AS DOUBLE), CASE WHEN minimum < -50000 THEN 'METRIC_BOUNDARY_FAILED' END FROM m
UNION ALL SELECT 'n_distinct', CAST(n_distinct AS DOUBLE), CASE WHEN n_distinct > 10 THEN 'METRIC_BOUNDARY_FAILED' END FROM m
UNION ALL SELECT 'total', CAST(total AS DOUBLE), CASE WHEN total < 0 THEN 'METRIC_BOUNDARY_FAILED' END FROM m
"""


def iqr_outliers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (cents("o_totalprice") * F.when(F.col("o_orderkey") % 300 == 0, 20).otherwise(1)).alias("c"))
    return quality.iqr_outliers(o, "c", 1.5, ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "o_orderstatus", "c")


IQR = f"""
WITH v AS (SELECT o_orderkey, o_orderstatus, {sql_cents('o_totalprice')} * CASE WHEN o_orderkey % 300 = 0 THEN 20 ELSE 1 END AS c FROM orders),
q AS (SELECT o_orderstatus, quantile_cont(CAST(c AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(c AS DOUBLE), 0.75) AS q3 FROM v GROUP BY 1)
SELECT o_orderkey, v.o_orderstatus, c FROM v JOIN q USING (o_orderstatus) WHERE c < q1 - 1.5 * (q3 - q1) OR c > q3 + 1.5 * (q3 - q1)
"""


def source_accounting(spark, d):
    physical = table(spark, d, "customer").select(F.col("c_custkey").alias("src_row"))
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("src_row"), F.col("o_orderkey").alias("out_row"))
    return quality.source_accounting(physical, lines)


SOURCE_ACCOUNTING = "SELECT c_custkey AS src_row, count(o_orderkey) AS n_canonical, CASE WHEN count(o_orderkey) > 0 THEN 'REPRESENTED' ELSE 'UNREPRESENTED' END AS accounting FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def staging_reconciliation(spark, d):
    """Rows in, used, out, combined and unrepresented, per dataset."""
    p = table(spark, d, "part")
    parents = parent_child_split(spark, d).agg(F.count(F.lit(1)).alias("n_output"), F.sum(F.col("n_rows")).alias("n_used"), F.sum(F.col("n_rows") - 1).alias("n_combined"))
    return p.agg(F.count(F.lit(1)).alias("n_input"), F.count_distinct(F.struct("p_name", "p_brand")).alias("n_tuples")).join(F.broadcast(parents)).withColumn("n_unrepresented", F.col("n_input") - F.col("n_used"))


STAGING = f"""
SELECT (SELECT count(*) FROM part) AS n_input, (SELECT count(*) FROM (SELECT DISTINCT p_name, p_brand FROM part)) AS n_tuples, count(*) AS n_output, CAST(sum(n_rows) AS BIGINT) AS n_used, CAST(sum(n_rows - 1) AS BIGINT) AS n_combined,
  (SELECT count(*) FROM part) - CAST(sum(n_rows) AS BIGINT) AS n_unrepresented FROM ({PARENT_SPLIT})
"""


def sparse_overlay(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return paging.overlay(o, o.filter("o_orderkey % 100 = 0").select("o_orderkey", F.lit("HELD").alias("status")), ["o_orderkey"], ["status"])


SPARSE_OVERLAY = "SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'HELD' ELSE o_orderstatus END AS status FROM orders"


def keyset_page(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return paging.keyset_page(o, "o_orderkey", after=700, size=50).unionByName(paging.keyset_page(o, "o_orderkey", before=300, size=50))


KEYSET_PAGE = "(SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 50) UNION ALL (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 300 ORDER BY o_orderkey DESC LIMIT 50)"


def offset_page(spark, d):
    o = paging.filtered(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"})
    return paging.offset_page(o, ["o_orderkey"], 3, 20)


OFFSET_PAGE = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' ORDER BY o_orderkey LIMIT 20 OFFSET 40"


def search(spark, d):
    return table(spark, d, "part").filter(paging.search(["p_name", "p_brand", "p_type"], "ECO")).select("p_partkey", "p_name", "p_type")


SEARCH = "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'eco') OR contains(lower(p_brand), 'eco') OR contains(lower(p_type), 'eco')"

# ---------------------------------------------------------------- resolution

FUZZY = ResolutionRule("parts", ("block",), (("p_name", "levenshtein", 2.0), ("p_type", "jaccard", 1.0)), 0.8)


def _fuzzy_rows(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", F.when(F.col("p_partkey") % 60 == 0, "").otherwise(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_size").cast("string"))).alias("block"))


def fuzzy_candidates(spark, d):
    return resolve.candidates(_fuzzy_rows(spark, d), FUZZY, "p_partkey")[0]


_MICRO = "(({n}) * 2000000 // (({d}) * 2) + CASE WHEN ({n}) * 2000000 % (({d}) * 2) > ({d}) OR (({n}) * 2000000 % (({d}) * 2) = ({d}) AND ({n}) * 2000000 // (({d}) * 2) % 2 = 1) THEN 1 ELSE 0 END)"
FUZZY_CANDIDATES = f"""
WITH k AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_brand || ' ' || p_size), '[^a-z0-9]+', ' ', 'g')) AS block, p_name AS a, lower(p_type) AS t FROM part WHERE p_partkey % 60 <> 0),
s AS (SELECT block FROM k GROUP BY block HAVING count(*) BETWEEN 2 AND 50),
p AS (SELECT l.id AS left_id, r.id AS right_id, block, levenshtein(l.a, r.a) AS d, greatest(length(l.a), length(r.a)) AS m, CAST(l.t = r.t AS BIGINT) AS j FROM k l JOIN k r USING (block) JOIN s USING (block) WHERE l.id < r.id),
w AS (SELECT left_id, right_id, block, {_MICRO.format(n='(m - d)', d='m')} * 2000 + j * 1000000 * 1000 AS w FROM p)
SELECT left_id, right_id, block, CAST({_MICRO.format(n='w', d='3000000000')} AS BIGINT) AS score FROM w WHERE {_MICRO.format(n='w', d='3000000000')} >= 800000
"""


def fuzzy_findings(spark, d):
    rows = _fuzzy_rows(spark, d).withColumn("block", F.when(F.col("p_partkey") % 60 == 0, "").otherwise(F.col("p_type")))
    return resolve.candidates(rows, FUZZY, "p_partkey")[1]


FUZZY_FINDINGS = """
SELECT 'FUZZY_BLOCKING_VALUE_MISSING' AS code, '' AS block, count(*) AS n FROM part WHERE p_partkey % 60 = 0 HAVING count(*) > 0
UNION ALL SELECT 'FUZZY_BLOCK_TOO_LARGE', lower(p_type), count(*) FROM part WHERE p_partkey % 60 <> 0 GROUP BY 2 HAVING count(*) > 50
"""


def degree_bounded_candidates(spark, d):
    return resolve.bounded_degree(fuzzy_candidates(spark, d), 1)


def _same(spark, d):
    # neighbours of equal type
    p = table(spark, d, "part").select("p_partkey", "p_type")
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_type").alias("t"))
    return p.join(q, "p_partkey").select((F.col("p_partkey") - 1).alias("left_id"), F.col("p_partkey").alias("right_id"), F.when(F.col("p_type") == F.col("t"), "SAME_RECORD").otherwise("KEEP_SEPARATE").alias("decision"))


def merge_components(spark, d):
    return resolve.merge_groups(_same(spark, d))[0]


_COMPONENTS = """
SELECT node, component FROM (SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY g) AS component, count(*) OVER (PARTITION BY g) AS n FROM (
  SELECT p_partkey, sum(b) OVER (ORDER BY p_partkey) AS g FROM (SELECT p_partkey, CASE WHEN p_type = lag(p_type) OVER (ORDER BY p_partkey) THEN 0 ELSE 1 END AS b FROM part))) WHERE n > 1
"""


def survivors(spark, d):
    return resolve.survivors(table(spark, d, "part"), merge_components(spark, d), "p_partkey", ["p_name", "p_type", "p_size"])


SURVIVORS = f"""
WITH c AS ({_COMPONENTS}), l AS (SELECT component, p_partkey, unnest([{{'field': 'p_name', 'value': p_name}}, {{'field': 'p_type', 'value': p_type}}, {{'field': 'p_size', 'value': CAST(p_size AS VARCHAR)}}], recursive := TRUE) FROM part JOIN c ON node = p_partkey)
SELECT component, field, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, CASE WHEN count(DISTINCT value) = 1 THEN min(p_partkey) END AS from_row, count(DISTINCT value) > 1 AS conflict, count(*) AS n_members FROM l GROUP BY component, field
"""


def effective_accounting(spark, d):
    same = _same(spark, d)
    groups, _ = resolve.merge_groups(same)
    return resolve.effective_accounting(table(spark, d, "part"), groups, same.filter("decision = 'KEEP_SEPARATE'"), "p_partkey")


EFFECTIVE = f"""
WITH c AS ({_COMPONENTS}), n AS (SELECT p_partkey, p_type, lag(p_type) OVER (ORDER BY p_partkey) AS before, lead(p_type) OVER (ORDER BY p_partkey) AS after FROM part)
SELECT p_partkey, component, CASE WHEN component IS NOT NULL THEN 'CONTRIBUTED_TO_SURVIVOR' WHEN before <> p_type OR after <> p_type THEN 'KEPT_DISTINCT' ELSE 'PASSED_THROUGH' END AS accounting
FROM n LEFT JOIN c ON node = p_partkey
"""


def list_split(spark, d):
    p = table(spark, d, "part")
    made = text.split_list(F.concat(F.replace("p_name", F.lit(" "), F.lit("; ")), F.when(F.col("p_partkey") % 3 == 0, ";").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" ;"), F.element_at(F.split("p_name", " "), 1))).otherwise("")), ";")
    return p.select("p_partkey", F.array_join(made["items"], ",").alias("items"), made["blank"].alias("blank"), made["duplicate"].alias("duplicate"))


LIST_SPLIT = """
SELECT p_partkey, array_to_string(list_filter([w[1], CASE WHEN w[2] <> w[1] THEN w[2] END], lambda x: x IS NOT NULL), ',') AS items, p_partkey % 3 = 0 AS blank, p_partkey % 3 = 1 OR w[1] = w[2] AS duplicate FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
"""

QUERIES = {
    "classify_orders": (classify_orders, CLASSIFY_ORDERS),
    "class_counts": (class_counts, CLASS_COUNTS),
    "classify_ambiguous_lines": (classify_ambiguous_lines, CLASSIFY_LINES),
    "field_diff_customers": (field_diff_customers, FIELD_DIFF),
    "set_ops_replace": (_set_ops("replace"), _set_sql("p")),
    "set_ops_add": (_set_ops("add"), _set_sql("list_sort(list_distinct(list_concat(e, p)))")),
    "set_ops_remove": (_set_ops("remove"), _set_sql("list_sort(list_filter(e, lambda x: NOT list_contains(p, x)))")),
    "resolve_references": (resolve_references, RESOLVE_REFERENCES),
    "business_keys": (business_keys, BUSINESS_KEYS),
    "issue_grouping": (issue_grouping, ISSUE_GROUPING),
    "three_way_compare": (three_way_compare, THREE_WAY),
    "write_intents": (write_intents, WRITE_INTENTS),
    "reconcile_status": (reconcile_status, RECONCILE_STATUS),
    "reconcile_run": (reconcile_run, RECONCILE_RUN),
    "read_requirements": (read_requirements, READ_REQUIREMENTS),
    "exact_left_join_lineage": (exact_left_join_lineage, EXACT_JOIN),
    "join_reconciliation": (join_reconciliation, JOIN_RECONCILIATION),
    "reference_lookup": (reference_lookup, REFERENCE_LOOKUP),
    "union_all_accounting": (union_all_accounting, UNION_ALL),
    "group_count_sum": (group_count_sum, GROUP_COUNT),
    "parent_child_split": (parent_child_split, PARENT_SPLIT),
    "split_preview": (split_preview, SPLIT_PREVIEW),
    "derived_hierarchy": (derived_hierarchy, DERIVED_HIERARCHY),
    "derived_references": (derived_references, DERIVED_REFERENCES),
    "impact_ledger": (impact_ledger, IMPACT_LEDGER),
    "normalization_groups": (normalization_groups, NORMALIZATION_GROUPS),
    "rule_impacts": (rule_impacts, RULE_IMPACTS),
    "outcome_counts": (outcome_counts, OUTCOME_COUNTS),
    "top5_examples": (top5_examples, TOP5),
    "duplicate_identities": (duplicate_identities, DUPLICATES),
    "identity_collisions": (identity_collisions, COLLISIONS),
    "order_check_lag": (order_check_lag, ORDER_CHECK),
    "row_ordinals": (row_ordinals, ROW_ORDINALS),
    "artifact_integrity": (artifact_integrity, ARTIFACT_INTEGRITY),
    "column_profile": (column_profile, COLUMN_PROFILE),
    "value_choices": (value_choices, VALUE_CHOICES),
    "choice_tuples": (choice_tuples, CHOICE_TUPLES),
    "uncovered_categories": (uncovered_categories, UNCOVERED),
    "relationship_states": (relationship_states, RELATIONSHIP_STATES),
    "unsafe_propagation": (unsafe_propagation, UNSAFE),
    "unsafe_chain": (unsafe_chain, UNSAFE_CHAIN),
    "unsafe_closure": (unsafe_closure, UNSAFE_CLOSURE),
    "quality_issues": (quality_issues, QUALITY_ISSUES),
    "quality_dispositions": (quality_dispositions, QUALITY_DISPOSITIONS),
    "quarantine_entries": (quarantine_entries, QUARANTINE),
    "metric_boundaries": (metric_boundaries, METRICS),
    "iqr_outliers": (iqr_outliers, IQR),
    "source_accounting": (source_accounting, SOURCE_ACCOUNTING),
    "staging_reconciliation": (staging_reconciliation, STAGING),
    "sparse_overlay": (sparse_overlay, SPARSE_OVERLAY),
    "keyset_page": (keyset_page, KEYSET_PAGE),
    "offset_page": (offset_page, OFFSET_PAGE),
    "search": (search, SEARCH),
    "fuzzy_candidates": (fuzzy_candidates, FUZZY_CANDIDATES),
    "fuzzy_findings": (fuzzy_findings, FUZZY_FINDINGS),
    "degree_bounded_candidates": (degree_bounded_candidates, None),
    "merge_components": (merge_components, _COMPONENTS),
    "survivors": (survivors, SURVIVORS),
    "effective_accounting": (effective_accounting, EFFECTIVE),
    "list_split": (list_split, LIST_SPLIT),
}
