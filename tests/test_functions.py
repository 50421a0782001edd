"""Column builders against plain Python."""

from __future__ import annotations

import decimal
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import checks, convert, text
from tidemark.functions.formula import FormulaError, formula

CASES = [None, "", " ", "  abc  ", " x y \t z\x1c", "o'neil mc-donald 3rd", "éclair ÉTÉ", "123-456.7 8", "a  b\n\nc", "=1+1", "\t@x", "ß straße"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, s string")


def values(df, *columns):
    rows = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return list(zip(*[tuple(r)[1:] for r in rows], strict=True))


def test_white_space_and_case(frame):
    s = F.col("s")
    trimmed, collapsed, title, sentence, upper = values(frame, text.trim(s), text.collapse(s), text.title_case(s), text.sentence_case(s), text.change_case(s, "upper"))
    for c, t, k, ti, se in zip(CASES, trimmed, collapsed, title, sentence, strict=True):
        if c is None:
            assert t is k is ti is se is None
            continue
        assert t == c.strip()
        assert k == __import__("re").sub(r"\s+", " ", c)
        if "ß" not in c:
            assert ti == c.title()
        first = next((j for j, ch in enumerate(c) if ch.isalpha()), None)
        assert se == (c if first is None else c[:first] + c[first].upper() + c[first + 1 :])


def test_trim_takes_all_white_space(spark):
    cases = [chr(c) + "x" + chr(c) for c in [*range(1, 0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF]] + ["\u3000\u2003 a b \x1f\x85", "\u3000"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    assert list(values(df, text.trim(F.col("s")))[0]) == [c.strip() for c in cases]


def test_replacements(frame):
    s = F.col("s")
    first, every, prefix, suffix, pattern, once, digits = values(
        frame, text.replace_literal(s, "b", "BB", every=False), text.replace_literal(s, "c", ""), text.replace_prefix(s, "o'", "O-"), text.replace_suffix(s, "3rd", "III"),
        text.replace_pattern(s, "[0-9]+", "#"), text.replace_pattern(s, "([a-z])([a-z])", r"\2\1$", every=False), text.remove_separators_between_digits(s, "-. "),
    )
    import re

    for i, c in enumerate(CASES):
        if c is None:
            continue
        assert first[i] == c.replace("b", "BB", 1) and every[i] == c.replace("c", "")
        assert prefix[i] == ("O-" + c[2:] if c.startswith("o'") else c)
        assert suffix[i] == (c[:-3] + "III" if c.endswith("3rd") else c)
        assert pattern[i] == re.sub("[0-9]+", "#", c)
        assert once[i] == re.sub("([a-z])([a-z])", r"\2\1$", c, count=1)
        assert digits[i] == re.sub(r"(?<=[0-9])[-. ]+(?=[0-9])", "", c)


def test_keys_and_displays(frame, spark):
    s = F.col("s")
    key, fuzzy, safe, label = values(frame, text.normalized_key(s), text.fuzzy_text(s, True), text.formula_safe(s), text.record_label([s, F.lit("z")], F.col("i")))
    assert key[4] == "x y z" and key[2] is None
    assert fuzzy[5] == "o neil mc donald 3rd" and fuzzy[11] == "ss strasse"
    assert safe[9] == "'=1+1" and safe[10] == "'\t@x" and safe[3] == "  abc  "
    assert label[3] == "  abc   / z" and label[0] == "z"
    parts = spark.createDataFrame([("A / b/ C",), ("a//b",), (" ",), (None,)], "p string").select(text.path_parts(F.col("p"), "/").alias("x")).collect()
    assert [r.x for r in parts] == [["A", "b", "C"], None, None, None]


def test_patterns_are_guarded():
    for bad in ("(a+)+", r"(a)\1", "(?=x)", "(", "x" * 501, "(?P<n>a)(?P=n)", "()" * 51):
        with pytest.raises(text.UnsafePattern):
            text.guarded_pattern(bad)
    assert text.guarded_pattern(r"([A-Z]{2})[0-9]+") == r"([A-Z]{2})[0-9]+"


def test_numbers(spark):
    texts = ["1", "-2.50", "1,234.5", "1.234,5", "1 234,5", "12,34", "", "abc", "+7", "1234567.891", ".5", "١٢"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    s = F.col("s")
    invariant, us, de, fr, whole = values(df, convert.parse_decimal(s), convert.parse_decimal(s, "en_US"), convert.parse_decimal(s, "de_DE"), convert.parse_decimal(s, "fr_FR"), convert.parse_integer(s))
    d = decimal.Decimal
    assert invariant == (d(1), d("-2.5"), None, None, None, None, None, None, d(7), d("1234567.891"), d("0.5"), None)
    assert us[2] == d("1234.5") and us[5] is None and de[3] == d("1234.5") and fr[4] == d("1234.5") and de[5] == d("12.34")
    assert whole == (1, None, None, None, None, None, None, None, 7, None, None, None)


def test_rounding(spark):
    modes = {"half_up": decimal.ROUND_HALF_UP, "half_even": decimal.ROUND_HALF_EVEN, "up": decimal.ROUND_UP, "down": decimal.ROUND_DOWN, "ceiling": decimal.ROUND_CEILING, "floor": decimal.ROUND_FLOOR}
    numbers = ["1.005", "2.5", "-2.5", "0.045", "-0.041", "7", "-1.999", "0"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, s string")
    for places in (0, 1, 2):
        found = values(df, *[convert.round_decimal(F.col("s").cast("decimal(20,3)"), places, m) for m in modes])
        for column, mode in zip(found, modes.values(), strict=True):
            assert list(column) == [decimal.Decimal(n).quantize(decimal.Decimal(1).scaleb(-places), mode) for n in numbers]


def test_dates_and_booleans(spark):
    texts = ["2026-07-28", "2026-7-8", "20260728", "31/12/2025", "12/31/2025", "8/7/2026", "30.2.2024", "1.2.2024", "2024-02-30", "yes", "N", "2026-07-28T10:00:00+02:00", "2026-07-28 10:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    s = F.col("s")
    iso, dmy, mdy, dot, boolean, moment = values(df, *[convert.parse_date(s, f).cast("string") for f in convert.DATES], convert.parse_boolean(s), convert.datetime_text(convert.parse_datetime(s)))
    assert [x for x in iso if x] == ["2026-07-28"]
    assert (dmy[3], dmy[4], dmy[5]) == ("2025-12-31", None, "2026-07-08") and (mdy[3], mdy[4]) == (None, "2025-12-31")
    assert (dot[6], dot[7]) == (None, "2024-02-01") and (boolean[9], boolean[10], boolean[0]) == (True, False, None)
    assert (moment[11], moment[12]) == ("2026-07-28T08:00:00Z", "2026-07-28T10:00:00Z")


def test_null_policies_and_validations(spark):
    df = spark.createDataFrame([(0, None, ""), (1, "", None), (2, None, "x"), (3, "x", "x"), (4, "ab12", "ab12")], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    distinct, equivalent, ignore, length, last, pattern = values(df, *[convert.values_equal(a, b, p) for p in ("distinct", "equivalent", "ignore_source_null")], convert.wrong_length(a, 4), convert.wrong_characters(a, "digits", "last", 2), convert.wrong_pattern(a, "[a-z]+[0-9]+"))
    assert distinct == (False, False, False, True, True) and equivalent == (True, True, False, True, True) and ignore == (True, False, True, True, True)
    assert length[4] is False and last[3] is True and last[4] is False and pattern[4] is False


def test_checksums(spark):
    df = spark.createDataFrame([(0, "4539 1488 0343 6467"), (1, "8273 1232 7352 0569"), (2, ""), (3, None), (4, "GB82 WEST 1234 5698 7654 32"), (5, "GB82 WEST 1234 5698 7654 33")], "i int, s string")
    luhn, iban = values(df, checks.luhn(F.col("s")), checks.iban(F.col("s")))
    assert luhn == (True, False, True, True, False, False) and iban == (False, False, True, True, True, False)
    ids = df.select("i", checks.uuid5(F.col("s"), uuid.NAMESPACE_URL).alias("u")).collect()
    assert all(r.u == (None if CASE is None else str(uuid.uuid5(uuid.NAMESPACE_URL, CASE))) for r, CASE in zip(ids, [r.s for r in df.collect()], strict=True))


def test_table_hash_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    one = checks.table_hash(df, ["i", "s"]).first()
    assert checks.table_hash(df.orderBy(F.desc("i")), ["i", "s"]).first() == one
    assert checks.table_hash(df.limit(2), ["i", "s"]).first() != one


def test_formulas(spark):
    df = spark.createDataFrame([(0, "007", "ab", ""), (1, "2.5", None, "x")], "i int, n string, s string, e string")
    names = {c: (F.col(c), "text") for c in ("n", "s", "e")}
    f = lambda e: formula(e, names)
    joined, total, label, first, tail, text_sum = values(df, f("concat(n, 'x')"), f("n * 2 + 1").cast("string"), f("'big' if n > 5 and not e else 'small'"), f("coalesce(e, s, 'none')"), f("substring('abcdef', -2)"), f("s + 'c'"))
    assert joined == ("7x", "2.5x") and [decimal.Decimal(t) for t in total] == [15, 6]
    assert label == ("big", "small") and first == ("ab", "x") and tail == ("ef", "ef") and text_sum == ("abc", None)
    for bad in ("__import__('os')", "n.real", "[1]", "unknown + 1", "lambda: 1", "concat(s=1)", "1" * 1001, "+".join(["n"] * 80), "open('x')", "True + 1"):
        with pytest.raises(FormulaError):
            f(bad)
