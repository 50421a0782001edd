"""Text, conversion, provider, rule and check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import checks, convert, text
from tidemark.functions.formula import formula
from tidemark.operators.identity import control_total, exact_sum
from tidemark.plans.compile import compile_field, map_by_join, prepare, rule_overlap, selected
from tidemark.plans.contracts import Check, Condition, DatasetSpec, FieldSpec, Rule, TextStep
from tidemark.queries.base import cents, money, sql_cents, sql_money, table


def text_pipeline(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.lit(" \t"), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" \n"))
    step = text.replace_literal(text.collapse(text.trim(raw)), "r", "R", every=False)
    return p.select(
        "p_partkey",
        text.trim(raw).alias("trimmed"),
        text.collapse(text.trim(raw)).alias("collapsed"),
        step.alias("first_r"),
        text.replace_literal(F.col("p_name"), "e", "3").alias("every_e"),
        text.replace_prefix(F.col("p_brand"), "Brand#", "B-").alias("brand"),
        text.replace_suffix(F.col("p_name"), "bolt", "BOLT").alias("suffix"),
        text.sentence_case(F.col("p_name")).alias("sentence"),
        text.change_case(F.col("p_name"), "upper").alias("upper"),
        text.title_case(F.concat(F.col("p_name"), F.lit("-o'neil 3rd"))).alias("title"),
        text.empty_as_null(F.when(F.col("p_size") < 10, "").otherwise(F.col("p_type"))).alias("blank_null"),
    )


TEXT_PIPELINE = r"""
SELECT p_partkey,
  regexp_replace(' ' || chr(9) || replace(p_name, ' ', '  ') || ' ' || chr(10), '^\s+|\s+$', '', 'g') AS trimmed,
  p_name AS collapsed,
  regexp_replace(p_name, 'r', 'R') AS first_r,
  replace(p_name, 'e', '3') AS every_e,
  regexp_replace(p_brand, '^Brand#', 'B-') AS brand,
  regexp_replace(p_name, 'bolt$', 'BOLT') AS suffix,
  upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS sentence,
  upper(p_name) AS upper,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || '-O''Neil 3Rd' AS title,
  CASE WHEN p_size < 10 THEN NULL ELSE p_type END AS blank_null
FROM part
"""


def regex_cleanup(spark, d):
    doc = table(spark, d, "documents")
    t = F.col("text")
    return doc.select(
        "doc_id",
        text.replace_pattern(t, "[^A-Za-z0-9 ]+", "").alias("plain"),
        text.replace_pattern(t, "([a-z]+) ([a-z]+)", r"\2 \1", every=False).alias("swapped"),
        text.remove_separators_between_digits(F.concat(F.col("doc_id").cast("string"), F.lit("-.12.-3 x-4-")), "-.").alias("digits"),
    )


REGEX_CLEANUP = r"""
SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]+', '', 'g') AS plain,
  regexp_replace(text, '([a-z]+) ([a-z]+)', '\2 \1') AS swapped,
  CAST(doc_id AS VARCHAR) || '123 x-4-' AS digits
FROM documents
"""


def decimal_locale_parse(spark, d):
    li = table(spark, d, "lineitem")
    c = cents("l_extendedprice")
    whole, rest = F.floor(c / 100), F.lpad(F.pmod(c, F.lit(100)).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    shown = {
        "invariant": F.concat(whole.cast("string"), F.lit("."), rest),
        "en_US": F.concat(grouped, F.lit("."), rest),
        "de_DE": F.concat(F.translate(grouped, ",", "."), F.lit(","), rest),
        "fr_FR": F.concat(F.translate(grouped, ",", " "), F.lit(","), rest),
    }
    parsed = [(convert.parse_decimal(t, loc, 2) * 100).cast("bigint").alias(f"c_{loc.lower()}") for loc, t in shown.items()]
    wrong = convert.parse_decimal(F.concat(F.lit("1,2"), rest), "en_US", 2)
    return li.select("l_orderkey", "l_linenumber", *parsed, wrong.isNull().alias("wrong_group"))


# "1,2" and two digits has a group of three: it is well formed
DECIMAL_LOCALE = f"""
SELECT l_orderkey, l_linenumber, c AS c_invariant, c AS c_en_us, c AS c_de_de, c AS c_fr_fr, FALSE AS wrong_group
FROM (SELECT l_orderkey, l_linenumber, {sql_cents('l_extendedprice')} AS c FROM lineitem)
"""


def rounding_modes(spark, d):
    li = table(spark, d, "lineitem")
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    value = (cents("l_extendedprice") * sign).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")
    value = value.cast("decimal(20,2)")
    return li.select("l_orderkey", "l_linenumber", *[(convert.round_decimal(value, 1, m) * 10).cast("bigint").alias(m) for m in convert.ROUNDINGS])


ROUNDING_MODES = f"""
SELECT l_orderkey, l_linenumber,
  s * ((a + 5) // 10) AS half_up,
  s * (CASE WHEN a % 10 > 5 OR (a % 10 = 5 AND (a // 10) % 2 = 1) THEN a // 10 + 1 ELSE a // 10 END) AS half_even,
  s * ((a + 9) // 10) AS up, s * (a // 10) AS down,
  CASE WHEN s > 0 THEN (a + 9) // 10 ELSE -(a // 10) END AS ceiling,
  CASE WHEN s > 0 THEN a // 10 ELSE -((a + 9) // 10) END AS floor
FROM (SELECT l_orderkey, l_linenumber, {sql_cents('l_extendedprice')} AS a, CAST(CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS BIGINT) AS s FROM lineitem)
"""


def boolean_parse(spark, d):
    o = table(spark, d, "orders")
    words = F.array(*map(F.lit, ["true", "YES", "1", "y", "False", "no", "0", "N", "t", "on", ""]))
    raw = F.get(words, (F.col("o_orderkey") % 11).cast("int"))
    return o.select("o_orderkey", convert.parse_boolean(raw).alias("parsed"))


BOOLEAN_PARSE = """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 IN (0, 1, 2, 3) THEN TRUE WHEN o_orderkey % 11 IN (4, 5, 6, 7) THEN FALSE END AS parsed FROM orders
"""


def date_formats(spark, d):
    li = table(spark, d, "lineitem")
    ts = F.col("l_shipdate")
    shown = {"iso": F.date_format(ts, "yyyy-MM-dd"), "dmy_slash": F.date_format(ts, "d/M/yyyy"), "mdy_slash": F.date_format(ts, "MM/dd/yyyy"), "dmy_dot": F.date_format(ts, "d.MM.yyyy")}
    parsed = [convert.parse_date(t, form).cast("string").alias(f"d_{form}") for form, t in shown.items()]
    moment = convert.datetime_text(convert.parse_datetime(F.concat(shown["dmy_slash"], F.lit(" 7:05:09")), "dmy_slash"))
    bad = convert.parse_date(F.concat(F.lit("31/2/"), F.date_format(ts, "yyyy")), "dmy_slash")
    return li.select("l_orderkey", "l_linenumber", *parsed, moment.alias("moment"), bad.isNull().alias("no_such_day"))


DATE_FORMATS = """
SELECT l_orderkey, l_linenumber, s AS d_iso, s AS d_dmy_slash, s AS d_mdy_slash, s AS d_dmy_dot, s || 'T07:05:09Z' AS moment, TRUE AS no_such_day
FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS s FROM lineitem)
"""

RULES = (
    Rule((Condition("c_acctbal", "lt", "0", "decimal"),), "debtor"),
    Rule((Condition("c_mktsegment", "equals_ignore_case", "machinery"), Condition("c_acctbal", "ge", "5000", "decimal")), "big machinery"),
    Rule((Condition("c_mktsegment", "starts_with", "AUTO"), Condition("c_name", "ends_with", "7")), "auto or seven", "any"),
    Rule((Condition("c_nationkey", "le", "3", "integer"), Condition("c_mktsegment", "is_not_blank")), "near"),
)


def selection_rules(spark, d):
    c = table(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 50 == 0, F.lit("n/a")).otherwise(money(cents("c_acctbal"))))
    value, invalid, undecided = selected(RULES, None)
    n, first = rule_overlap(RULES)
    return c.select("c_custkey", value.alias("picked"), invalid.alias("invalid"), undecided.alias("undecided"), n.cast("bigint").alias("n_rules"), first.cast("bigint").alias("first_rule"))


SELECTION_RULES = f"""
SELECT c_custkey,
  CASE WHEN r1 THEN 'debtor' WHEN r2 THEN 'big machinery' WHEN r3 THEN 'auto or seven' WHEN r4 THEN 'near' END AS picked,
  c_custkey % 50 = 0 AS invalid, NOT (r1 OR r2 OR r3 OR r4) AS undecided,
  CAST(r1 AS BIGINT) + CAST(r2 AS BIGINT) + CAST(r3 AS BIGINT) + CAST(r4 AS BIGINT) AS n_rules,
  CAST(CASE WHEN r1 THEN 1 WHEN r2 THEN 2 WHEN r3 THEN 3 WHEN r4 THEN 4 END AS BIGINT) AS first_rule
FROM (SELECT c_custkey, c_custkey % 50 <> 0 AND b < 0 AS r1, lower(c_mktsegment) = 'machinery' AND c_custkey % 50 <> 0 AND b >= 500000 AS r2,
        starts_with(c_mktsegment, 'AUTO') OR c_name LIKE '%7' AS r3, c_nationkey <= 3 AS r4
      FROM (SELECT *, {sql_cents('c_acctbal')} AS b FROM customer))
"""


def value_mapping_fallback(spark, d):
    o = table(spark, d, "orders")
    raw = o.withColumn("status", F.when(F.col("o_orderkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" ")))).withColumn("prio", F.substr("o_orderpriority", F.lit(1), F.lit(1)))
    mapped = compile_field(FieldSpec("status", source="status", value_map=(("F", "filled"), ("O", "open")), case="lower"))
    kept = compile_field(FieldSpec("status", provider="fallback", source="status", constant="Unknown", case="upper"))
    joined = map_by_join(raw, "prio", spark.createDataFrame([("1", "urgent"), ("2", "high"), ("3", "medium")], "from_value string, to_value string"), "prio_name")
    return joined.select("o_orderkey", mapped["value"].alias("mapped"), kept["value"].alias("kept"), kept["fallback"].alias("used_fallback"), "prio_name")


VALUE_MAPPING = """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'filled' WHEN o_orderstatus = 'O' THEN 'open' ELSE lower(o_orderstatus) END AS mapped,
  CASE WHEN o_orderkey % 9 = 0 THEN 'UNKNOWN' ELSE o_orderstatus END AS kept, o_orderkey % 9 = 0 AS used_fallback,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' END AS prio_name
FROM orders
"""


def formula_margin(spark, d):
    li = table(spark, d, "lineitem").withColumns({"price": money(cents("l_extendedprice")), "qty": F.col("l_quantity").cast("bigint").cast("string")})
    names = {"price": (F.col("price"), "text"), "qty": (F.col("qty"), "text"), "flag": (F.col("l_returnflag"), "text")}
    f = lambda e: formula(e, names)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        (f("price * 2 - qty") * 100).cast("bigint").alias("twice"),
        f("'bulk' if qty >= 25 and not flag == 'R' else 'unit'").alias("label"),
        f("concat(upper(flag), '-', qty)").alias("code"),
        f("coalesce('', flag)").alias("first_text"),
        f("substring(concat(flag, 'xyz'), -2)").alias("tail"),
        f("10 < qty <= 20").alias("middling"),
        f("length(flag) + abs(-2)").cast("bigint").alias("three"),
        f("1 / 0").isNull().alias("no_quotient"),
    )


FORMULA_MARGIN = f"""
SELECT l_orderkey, l_linenumber, {sql_cents('l_extendedprice')} * 2 - CAST(l_quantity AS BIGINT) * 100 AS twice,
  CASE WHEN l_quantity >= 25 AND l_returnflag <> 'R' THEN 'bulk' ELSE 'unit' END AS label,
  upper(l_returnflag) || '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS code, l_returnflag AS first_text, 'yz' AS tail,
  l_quantity > 10 AND l_quantity <= 20 AS middling, CAST(length(l_returnflag) + 2 AS BIGINT) AS three, TRUE AS no_quotient
FROM lineitem
"""

CUSTOMER = DatasetSpec(
    "customer",
    ("code",),
    (
        FieldSpec("code", source="code", required=True, checks=(Check("exact_length", n=9), Check("characters", "digits", 9, "last"))),
        FieldSpec("segment", source="segment", case="title", checks=(Check("pattern", "[A-Za-z]+"),)),
        FieldSpec("balance", source="balance", kind="decimal", locale="de_DE", places=1, rounding="half_even"),
        FieldSpec("nation", source="c_nationkey", kind="integer", required=True),
        FieldSpec("kind", provider="constant", constant="customer"),
        FieldSpec("note", provider="omit"),
    ),
)


def issue_list(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(
        "c_custkey", "c_nationkey",
        F.when(F.col("c_custkey") % 17 == 0, "").when(F.col("c_custkey") % 19 == 0, F.substr("c_name", F.lit(12), F.lit(7))).otherwise(F.substr("c_name", F.lit(10))).alias("code"),
        F.when(F.col("c_custkey") % 7 == 0, F.concat(F.col("c_mktsegment"), F.lit("!"))).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 23 == 0, "12,34,5").otherwise(F.translate(money(cents("c_acctbal")), ".", ",")).alias("balance"),
    )
    out = prepare(rows, CUSTOMER, ["c_custkey"])
    return out.select("c_custkey", "code", "segment", (F.col("balance") * 10).cast("bigint").alias("balance_tenths"), "kind", F.array_join(F.transform("issues", lambda i: F.concat(i["idx"].cast("string"), F.lit(":"), i["error"])), ";").alias("issues"))


ISSUE_LIST = f"""
SELECT c_custkey, code, segment, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE
    (CASE WHEN b < 0 THEN -1 ELSE 1 END) * (CASE WHEN abs(b) % 10 > 5 OR (abs(b) % 10 = 5 AND (abs(b) // 10) % 2 = 1) THEN abs(b) // 10 + 1 ELSE abs(b) // 10 END) END AS balance_tenths,
  'customer' AS kind,
  array_to_string(list_filter([
    CASE WHEN code IS NULL THEN '0:SOURCE_REQUIRED_VALUE_MISSING' WHEN length(code) <> 9 THEN '0:SOURCE_TEXT_LENGTH_INVALID' END,
    CASE WHEN c_custkey % 7 = 0 THEN '1:SOURCE_PATTERN_MISMATCH' END,
    CASE WHEN c_custkey % 23 = 0 THEN '2:SOURCE_TYPE_INVALID' END], lambda x: x IS NOT NULL), ';') AS issues
FROM (SELECT c_custkey, {sql_cents('c_acctbal')} AS b,
        CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN substr(c_name, 12, 7) ELSE substr(c_name, 10) END AS code,
        upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || CASE WHEN c_custkey % 7 = 0 THEN '!' ELSE '' END AS segment
      FROM customer)
"""


def checksum_rules(spark, d):
    c = table(spark, d, "customer")
    digits = F.lpad((F.col("c_custkey") * 7919 + 123456789).cast("string"), 12, "0")
    return c.select(
        "c_custkey",
        checks.luhn(F.concat(F.left(digits, F.lit(6)), F.lit(" "), F.substr(digits, F.lit(7)))).alias("luhn_ok"),
        checks.iban(F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 98).cast("string"), 2, "0"), F.lpad(digits, 18, "0"))).alias("iban_ok"),
        checks.postal(F.lpad((F.col("c_custkey") % 20000).cast("string"), 4, "0"), "BE").alias("postal_ok"),
        checks.date_window(F.concat(F.lit("2024-02-"), F.lpad((F.col("c_custkey") % 32).cast("string"), 2, "0")), "2024-02-05", "2024-02-25").alias("window_ok"),
    )


CHECKSUM_RULES = """
SELECT c_custkey,
  list_sum(list_transform(range(1, 13), lambda i: CASE WHEN (12 - i) % 2 = 1
    THEN (CAST(digits[i] AS INTEGER) * 2) // 10 + (CAST(digits[i] AS INTEGER) * 2) % 10 ELSE CAST(digits[i] AS INTEGER) END)) % 10 = 0 AS luhn_ok,
  CAST(lpad(digits, 18, '0') || '1314' || lpad(CAST(c_custkey % 98 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 AS iban_ok,
  regexp_full_match(lpad(CAST(c_custkey % 20000 AS VARCHAR), CAST(4 AS INTEGER), '0'), '[1-9][0-9]{3}') AS postal_ok,
  c_custkey % 32 BETWEEN 5 AND 25 AS window_ok
FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 123456789 AS VARCHAR), 12, '0') AS digits FROM customer)
"""


def code_list(spark, d):
    codes = table(spark, d, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return checks.not_in_code_list(table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], codes).select("c_custkey", "c_nationkey")


CODE_LIST = "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0)"


def row_hash(spark, d):
    import uuid

    c = table(spark, d, "customer")
    label = text.record_label([F.nullif("c_name", F.lit("")), F.col("c_mktsegment")], F.col("c_custkey"))
    return c.select("c_custkey", checks.content_hash([F.col("c_custkey"), F.col("c_name"), F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment"))]).alias("hash"), checks.uuid5(F.lit("python.org"), uuid.NAMESPACE_DNS).alias("dns_uuid"), label.alias("label"), text.joined_display([F.col("c_name"), F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment"))]).alias("display"))


ROW_HASH = """
SELECT c_custkey, sha256('{"c0":' || c_custkey || ',"c1":"' || c_name || '","c2":' || CASE WHEN c_nationkey > 5 THEN '"' || c_mktsegment || '"' ELSE 'null' END || '}') AS hash,
  '886313e1-3b8a-5372-9b90-0c9aee199e5d' AS dns_uuid, c_name || ' / ' || c_mktsegment AS label, c_name || ' | ' || CASE WHEN c_nationkey > 5 THEN c_mktsegment ELSE '—' END AS display
FROM customer
"""


def control_totals(spark, d):
    o = table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderkey") % 10 > 0, (cents("o_totalprice").cast("decimal(20,0)") / 100).cast("decimal(20,2)")))
    return control_total(o, F.col("price"), "0", "1000000").select((F.col("actual") * 100).cast("bigint").alias("actual_cents"), "n_included", "n_empty", "passed")


CONTROL_TOTALS = f"""
SELECT CAST(sum(CASE WHEN o_orderkey % 10 > 0 THEN {sql_cents('o_totalprice')} END) AS BIGINT) AS actual_cents, count(*) FILTER (o_orderkey % 10 > 0) AS n_included,
  count(*) FILTER (o_orderkey % 10 = 0) AS n_empty, sum(CASE WHEN o_orderkey % 10 > 0 THEN {sql_cents('o_totalprice')} END) <= 100000000 AS passed
FROM orders
"""


def exact_total(spark, d):
    return exact_sum(table(spark, d, "lineitem").select(money(cents("l_extendedprice")).alias("v")), "v")


EXACT_TOTAL = f"SELECT CAST(t // 100 AS VARCHAR) || '.' || lpad(CAST(t % 100 AS VARCHAR), 2, '0') AS total FROM (SELECT CAST(sum({sql_cents('l_extendedprice')}) AS BIGINT) AS t FROM lineitem)"


def clean_products(spark, d):
    """A wide prepared table: many fields of many kinds in one projection."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" ")).alias("flag"), money(cents("l_extendedprice")).alias("price"), F.col("l_quantity").cast("bigint").cast("string").alias("qty"), F.date_format("l_shipdate", "d/M/yyyy").alias("ship"), money(cents("l_discount")).alias("discount"))
    spec = DatasetSpec(
        "product", ("flag",),
        (
            FieldSpec("flag", source="flag", case="lower", required=True),
            FieldSpec("price", source="price", kind="decimal", places=1, rounding="half_up"),
            FieldSpec("qty", source="qty", kind="integer", required=True),
            FieldSpec("ship", source="ship", kind="date", form="dmy_slash"),
            FieldSpec("discount", source="discount", kind="decimal"),
            FieldSpec("state", provider="selection", rules=(Rule((Condition("qty", "ge", "30", "integer"),), "bulk"), Rule((Condition("flag", "equals", "R"),), "returned")), otherwise="plain"),
            FieldSpec("code", provider="formula", formula="concat(flag, '-', qty)", steps=(TextStep("literal", " ", ""),)),
        ),
    )
    out = prepare(li, spec, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "flag", (F.col("price") * 10).cast("bigint").alias("price_tenths"), F.col("qty").cast("bigint").alias("qty"), F.col("ship").cast("string").alias("ship"), (F.col("discount") * 100).cast("bigint").alias("discount_cents"), "state", "code", F.size("issues").cast("bigint").alias("n_issues"))


CLEAN_PRODUCTS = f"""
SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS flag, ({sql_cents('l_extendedprice')} + 5) // 10 AS price_tenths, CAST(l_quantity AS BIGINT) AS qty,
  strftime(l_shipdate, '%Y-%m-%d') AS ship, {sql_cents('l_discount')} AS discount_cents,
  CASE WHEN l_quantity >= 30 THEN 'bulk' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'plain' END AS state,
  l_returnflag || '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS code, CAST(0 AS BIGINT) AS n_issues
FROM lineitem
"""

QUERIES = {
    "text_pipeline": (text_pipeline, TEXT_PIPELINE),
    "regex_cleanup": (regex_cleanup, REGEX_CLEANUP),
    "decimal_locale_parse": (decimal_locale_parse, DECIMAL_LOCALE),
    "rounding_modes": (rounding_modes, ROUNDING_MODES),
    "boolean_parse": (boolean_parse, BOOLEAN_PARSE),
    "date_formats": (date_formats, DATE_FORMATS),
    "selection_rules": (selection_rules, SELECTION_RULES),
    "value_mapping_fallback": (value_mapping_fallback, VALUE_MAPPING),
    "formula_margin": (formula_margin, FORMULA_MARGIN),
    "issue_list": (issue_list, ISSUE_LIST),
    "checksum_rules": (checksum_rules, CHECKSUM_RULES),
    "code_list": (code_list, CODE_LIST),
    "row_hash": (row_hash, ROW_HASH),
    "control_totals": (control_totals, CONTROL_TOTALS),
    "exact_total": (exact_total, EXACT_TOTAL),
    "clean_products": (clean_products, CLEAN_PRODUCTS),
}
