"""Sources and sinks on written files, and what is left of the scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import convert, text
from tidemark.operators import profile, reshape
from tidemark.plans.compile import out_of_domain
from tidemark.queries.base import cents, money, sql_cents, table
from tidemark.sources import csvscan, paged, records, sinks, snapshot
from tidemark.streaming import capture


def _path(spark, name):
    return f"{snapshot.work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def snapshot_scan(spark, d):
    """Freeze a table, verify it and read a range of rows by a pushed-down filter."""
    path = _path(spark, "snapshot")
    facts = snapshot.freeze(table(spark, d, "customer").withColumnRenamed("c_custkey", "src_row"), path)
    return snapshot.untagged(snapshot.rows_between(snapshot.open_snapshot(spark, path, facts), 20, 120)).select("src_row", "c_name", "c_nationkey", "c_mktsegment")


SNAPSHOT_SCAN = "SELECT c_custkey AS src_row, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey >= 20 AND c_custkey < 120"


def snapshot_kinds(spark, d):
    path = _path(spark, "snapshot")
    df = table(spark, d, "customer").select(F.col("c_custkey").alias("src_row"), "c_name", "c_nationkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("c_acctbal"))
    snapshot.freeze(df, path)
    snapshot.compact(spark, path, f"{path}-compact", 2)
    s = spark.read.parquet(f"{path}-compact")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.k").cast("bigint").alias("kind")) for c in s.columns if c != "src_row"]))
    return s.select(pairs.alias("p")).select("p.*").groupBy("column_name", "kind").agg(F.count(F.lit(1)).alias("n"))


SNAPSHOT_KINDS = """
SELECT 'c_name' AS column_name, CAST(1 AS BIGINT) AS kind, count(*) AS n FROM customer UNION ALL SELECT 'c_nationkey', 3, count(*) FROM customer
UNION ALL SELECT 'c_acctbal', CASE WHEN c_custkey % 3 > 0 THEN 5 ELSE 0 END, count(*) FROM customer GROUP BY 1, 2
"""


def csv_round_trip(spark, d):
    """CSV sink, dialect sniffing and strict scan."""
    path = _path(spark, "csv")
    c = table(spark, d, "customer")
    sinks.write_csv(c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('say "x", '), F.col("c_mktsegment"))).otherwise(F.concat(F.lit("=1+"), F.col("c_mktsegment"))).alias("note")), path)
    return csvscan.scan_csv(spark, path, csvscan.Dialect("utf-8", ",")).drop("src_row")


CSV_ROUND_TRIP = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'say \"x\", ' || c_mktsegment ELSE '''=1+' || c_mktsegment END AS note FROM customer"


def record_document(spark, d):
    """A target snapshot document with references, read back."""
    path = _path(spark, "records")
    n = table(spark, d, "nation")
    value = F.map_from_arrays(F.array(F.lit("name"), F.lit("region"), F.lit("tags")), F.array(
        F.when(F.col("n_nationkey") % 6 == 0, "false").otherwise(F.concat(F.lit('"'), F.col("n_name"), F.lit('"'))),
        F.when(F.col("n_nationkey") % 4 == 0, "false").otherwise(F.concat(F.lit("["), F.col("n_regionkey").cast("string"), F.lit(',"r"]'))),
        F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(",7]")),
    ))
    row = F.concat(F.lit('{"id":'), F.col("n_nationkey").cast("string"), F.lit(',"values":{'), F.array_join(F.transform(F.map_entries("v"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}}"))
    rows = n.withColumn("v", value).select(row.alias("r")).agg(F.array_join(F.array_sort(F.collect_list("r")), ",").alias("all"))  # one document, as a connector writes it
    rows.select(F.concat(F.lit('{"metadata":{"fingerprint":{"t":1}},"records":{"fingerprint":{"t":1},"models":{"nation":{"records":['), F.col("all"), F.lit("]}}}}")).alias("value")).coalesce(1).write.text(path)
    records.open_document(spark, path)
    out = records.records(spark, path, "nation", {"name": "text", "region": "many2one", "tags": "many2many"})
    return out.select("id", "name", "region", F.array_join(F.transform("tags", lambda x: x.cast("string")), ",").alias("tags"))


RECORD_DOCUMENT = """
SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 6 <> 0 THEN n_name END AS name, CAST(CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey END AS BIGINT) AS region, n_nationkey || ',7' AS tags FROM nation
"""


def _fetch(after, up_to, limit):
    return [{"id": i, "name": f"Customer#{i:09d}"} for i in range(after + 1, up_to + 1)][:limit]


def paged_read(spark, d):
    """Keyset pages inside disjoint ranges of ids, one partition a range."""
    high = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    return paged.read_paged(spark, _fetch, "id long, name string", high, page=64, span=500, name="tidemark_query_pages")


PAGED_READ = "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey > 0"


def captured_stream(spark, d):
    """Incremental capture to a table by a streaming query with a checkpoint."""
    high = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    stream = capture.capture_stream(spark, _fetch, lambda: high, "id long, name string", page=500, name="tidemark_query_capture")
    out = _path(spark, "captured")
    capture.run_available(stream, out, _path(spark, "captured-mark"))
    return spark.read.schema("id long, name string").parquet(out)


def upsert_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changes = o.filter("o_orderkey % 9 = 0").select("o_orderkey", F.lit("Q").alias("o_orderstatus")).union(o.filter("o_orderkey < 5").select(-F.col("o_orderkey") - 1, F.lit("N")))
    return snapshot.upsert(o, changes, ["o_orderkey"])


UPSERT_ORDERS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'Q' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey - 1, 'N' FROM orders WHERE o_orderkey < 5
"""


def ragged_lines(spark, d):
    c = table(spark, d, "customer")
    lines = c.select(F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).when(F.col("c_custkey") % 7 == 1, F.concat_ws(",", "c_name", "c_mktsegment", "c_name")).when(F.col("c_custkey") % 7 == 2, " , ").otherwise(F.concat_ws(",", "c_name", "c_mktsegment")).alias("line"))
    return profile.ragged(lines, "line", ",", 2)


RAGGED_LINES = "SELECT count(*) FILTER (c_custkey % 7 <> 2) AS n_rows, count(*) FILTER (c_custkey % 7 = 0) AS n_short, count(*) FILTER (c_custkey % 7 = 1) AS n_long FROM customer"


def iso_datetimes(spark, d):
    e = table(spark, d, "events")
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    parsed = convert.parse_datetime(F.concat(F.when(F.col("event_id") % 4 == 0, F.left(shown, F.lit(19))).otherwise(shown), F.when(F.col("event_id") % 3 == 0, "+00:00").otherwise("Z")))
    wrong = convert.parse_datetime(F.replace(shown, F.lit("-"), F.lit("/")))
    return e.select("event_id", convert.datetime_text(parsed).alias("moment"), wrong.isNull().alias("wrong"))


ISO_DATETIMES = """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 4 = 0 OR strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS moment, TRUE AS wrong FROM events
"""


def target_scalars(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, "False").otherwise(money(cents("c_acctbal")))
    return c.select(
        "c_custkey",
        (convert.target_scalar(raw, "decimal") * 100).cast("bigint").alias("balance"),
        convert.target_scalar(F.when(k % 2 == 0, "False").otherwise("True"), "boolean").alias("flag"),
        convert.decimal_text(F.concat(F.when(k % 3 == 0, "+00").when(k % 3 == 1, "-0").otherwise(""), k.cast("string"), F.lit(".50"))).alias("plain"),
        text.masked(F.col("c_name"), True).alias("shown"),
        out_of_domain(F.col("c_mktsegment"), ["MACHINERY", "BUILDING", "FURNITURE"]).alias("outside"),
    )


TARGET_SCALARS = f"""
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN {sql_cents('c_acctbal')} END AS balance, c_custkey % 2 = 1 AS flag,
  CASE WHEN c_custkey % 3 = 1 THEN '-' ELSE '' END || c_custkey || '.50' AS plain, 'Hidden' AS shown, c_mktsegment NOT IN ('MACHINERY', 'BUILDING', 'FURNITURE') AS outside FROM customer
"""


def lossless_inner_join(spark, d):
    out, guards = reshape.exact_join(table(spark, d, "nation"), table(spark, d, "region"), [("n_regionkey", "r_regionkey")], ["r_name"], inner=True)
    for what, rows in guards.items():
        reshape.enforce(rows, what)
    return out.select("n_nationkey", "n_name", "r_name")


LOSSLESS_INNER_JOIN = "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey"


def preview_rows(spark, d):
    return profile.preview(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 20, 40)


PREVIEW_ROWS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(text, 1, 40) AS text FROM documents ORDER BY documents.doc_id LIMIT 20"

QUERIES = {
    "snapshot_scan": (snapshot_scan, SNAPSHOT_SCAN),
    "snapshot_kinds": (snapshot_kinds, SNAPSHOT_KINDS),
    "csv_round_trip": (csv_round_trip, CSV_ROUND_TRIP),
    "record_document": (record_document, RECORD_DOCUMENT),
    "paged_read": (paged_read, PAGED_READ),
    "captured_stream": (captured_stream, PAGED_READ),
    "upsert_orders": (upsert_orders, UPSERT_ORDERS),
    "ragged_lines": (ragged_lines, RAGGED_LINES),
    "iso_datetimes": (iso_datetimes, ISO_DATETIMES),
    "target_scalars": (target_scalars, TARGET_SCALARS),
    "lossless_inner_join": (lossless_inner_join, LOSSLESS_INNER_JOIN),
    "preview_rows": (preview_rows, PREVIEW_ROWS),
}
