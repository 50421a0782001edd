"""Checksum and domain predicates, hashes and identifiers.  Blank values pass the predicates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let

#: Postal code shapes by jurisdiction.
POSTAL = {
    "BE": r"[1-9][0-9]{3}",
    "DE": r"[0-9]{5}",
    "FR": r"[0-9]{5}",
    "LU": r"[0-9]{4}",
    "NL": r"[1-9][0-9]{3} ?[A-Z]{2}",
    "GB": r"[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}",
}


def _or_blank(c: Column, test: Column) -> Column:
    return c.isNull() | (F.trim(c) == "") | F.coalesce(test, F.lit(False))


def luhn(c: Column) -> Column:
    """Luhn checksum of digits, with spaces and hyphens between them."""
    compact = F.translate(c, " -", "")
    return _or_blank(c, compact.rlike(r"\A[0-9]+\z") & F.call_function("luhn_check", compact))


def iban(c: Column) -> Column:
    """ISO 13616: 15 to 34 characters, remainder 1 modulo 97."""
    compact = F.upper(F.regexp_replace(c, r"\s", ""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))
    digits = F.transform(F.split(turned, ""), lambda x: F.when(x.rlike("[0-9]"), x.try_cast("bigint")).otherwise(F.ascii(x).cast("bigint") - 55))
    rest = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)
    return _or_blank(c, F.when(compact.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z"), rest == 1))


def postal(c: Column, jurisdiction: str) -> Column:
    return _or_blank(c, F.upper(F.trim(c)).rlike(rf"\A(?:{POSTAL[jurisdiction]})\z"))


def date_window(c: Column, first: str | None = None, last: str | None = None) -> Column:
    """An ISO date (text or date) from ``first`` to ``last``, both included."""
    day = c.try_cast("date")
    test = day.isNotNull()
    test = test & (day >= F.lit(first).cast("date")) if first else test
    test = test & (day <= F.lit(last).cast("date")) if last else test
    return _or_blank(c.cast("string"), test)


def not_in_code_list(df: DataFrame, keys: list[str], codes: DataFrame) -> DataFrame:
    """Rows with a whole key that the approved list doesn't have."""
    whole = df.na.drop(subset=keys)
    return whole.join(codes.select(*keys).distinct(), keys, "left_anti")


def content_hash(columns: list[Column]) -> Column:
    """SHA-256 of the columns' JSON, nulls included, in the order given."""
    named = [c.alias(f"c{i}") for i, c in enumerate(columns)]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def table_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-insensitive hash of a table: rows and the sum of their hashes modulo 2**61 - 1, in two independent parts."""
    prime = (1 << 61) - 1
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    parts = [F.pmod(F.xxhash64(row, F.lit(seed)).cast("decimal(38,0)"), F.lit(prime).cast("decimal(38,0)")) for seed in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.pmod(F.coalesce(F.sum(p), F.lit(0).cast("decimal(38,0)")), F.lit(prime).cast("decimal(38,0)")).cast("bigint").alias(f"hash_{i}") for i, p in enumerate(parts, 1)])


def uuid5(c: Column, namespace: uuid.UUID) -> Column:
    """Name-based UUID (SHA-1) in its text form."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(c, "UTF-8")))
    fourth = F.lower(F.hex(F.conv(F.substr(digest, F.lit(17), F.lit(2)), 16, 10).cast("bigint").bitwiseAND(0x3F).bitwiseOR(0x80)))

    def form(h):
        cut = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
        return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), fourth, cut(19, 2), F.lit("-"), cut(21, 12))

    return let(digest, form)
