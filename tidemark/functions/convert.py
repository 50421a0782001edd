"""Conversions from text to typed values; what doesn't convert is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import normalized

TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
#: Locale -> grouping characters, decimal mark.
LOCALES = {"invariant": ("", "."), "en_US": (",", "."), "de_DE": (".", ","), "fr_FR": (" \u00a0\u202f", ",")}
#: Format name -> datetime pattern (lenient on leading zeros).
DATES = {"iso": "yyyy-MM-dd", "dmy_slash": "d/M/yyyy", "mdy_slash": "M/d/yyyy", "dmy_dot": "d.M.yyyy"}
DATETIMES = {"dmy_slash": "d/M/yyyy H:m:s", "mdy_slash": "M/d/yyyy H:m:s", "dmy_dot": "d.M.yyyy H:m:s"}
ROUNDINGS = ("half_up", "half_even", "up", "down", "ceiling", "floor")
ISO_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
ISO_DATETIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"


def parse_integer(c: Column) -> Column:
    return F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("decimal(38,0)"))


def parse_decimal(c: Column, locale: str = "invariant", scale: int = 12) -> Column:
    """Exact decimal of a locale; groups must have three digits."""
    group, mark = LOCALES[locale]
    point = r"\." if mark == "." else ","
    whole = f"[0-9]{{1,3}}(?:[{group}][0-9]{{3}})+|[0-9]+" if group else "[0-9]+"
    shape = rf"\A[+-]?(?:(?:{whole})(?:{point}[0-9]+)?|{point}[0-9]+)\z"
    plain = F.translate(c, group, "") if group else c
    plain = F.translate(plain, mark, ".") if mark != "." else plain
    return F.when(c.rlike(shape), plain.try_cast(f"decimal(38,{scale})"))


def round_decimal(c: Column, places: int, mode: str) -> Column:
    """Round a decimal by one of six modes."""
    n = F.lit(places)
    whole = {"half_up": lambda x: F.round(x, places), "half_even": lambda x: F.bround(x, places), "ceiling": lambda x: F.ceil(x, n), "floor": lambda x: F.floor(x, n)}
    if mode in whole:
        return whole[mode](c)
    size = F.ceil(F.abs(c), n) if mode == "up" else F.floor(F.abs(c), n)
    if mode not in ROUNDINGS:
        raise ValueError(f"rounding mode {mode!r}")
    return F.when(c < 0, -size).otherwise(size)


def parse_boolean(c: Column, strip: bool = False) -> Column:
    low = F.lower(F.trim(c)) if strip else F.lower(c)
    return F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False))


def parse_date(c: Column, form: str = "iso") -> Column:
    if form == "iso":
        return F.when(c.rlike(ISO_DATE), c.try_cast("date"))
    shape = {"dmy_slash": "/", "mdy_slash": "/", "dmy_dot": r"\."}[form]
    return F.when(c.rlike(rf"\A[0-9]{{1,2}}{shape}[0-9]{{1,2}}{shape}[0-9]{{4}}\z"), F.try_to_date(c, DATES[form]))


def parse_datetime(c: Column, form: str = "iso") -> Column:
    """A point in time; without an offset it is UTC (the session's time zone must be UTC)."""
    if form == "iso":
        return F.when(c.rlike(ISO_DATETIME), c.try_cast("timestamp"))
    return F.try_to_timestamp(c, F.lit(DATETIMES[form]))


def parse(c: Column, kind: str, locale: str = "invariant", form: str = "iso", scale: int = 12) -> Column:
    """By the name of a type."""
    return {
        "string": lambda: F.nullif(c, F.lit("")),
        "integer": lambda: parse_integer(c),
        "decimal": lambda: parse_decimal(c, locale, scale),
        "boolean": lambda: parse_boolean(c),
        "date": lambda: parse_date(c, form),
        "datetime": lambda: parse_datetime(c, form),
    }[kind]()


def canonical(c: Column, kind: str, places: int | None = None, **policy) -> Column:
    """One builder for source and target values, so that equal values get equal keys."""
    text = normalized(c.cast("string"), **policy)
    out = text if kind == "string" else parse_boolean(text) if kind == "boolean" else parse(text, kind)
    return F.round(out, places) if places is not None and kind == "decimal" else out


def values_equal(source: Column, target: Column, policy: str = "distinct") -> Column:
    """Null policies: distinct; equivalent (null and empty text are equal); ignore_source_null."""
    if policy == "distinct":
        return source.eqNullSafe(target)
    if policy == "equivalent":
        return F.nullif(source.cast("string"), F.lit("")).eqNullSafe(F.nullif(target.cast("string"), F.lit("")))
    if policy == "ignore_source_null":
        return source.isNull() | source.eqNullSafe(target)
    raise ValueError(f"null policy {policy!r}")


def decimal_text(c: Column) -> Column:
    """Decimal text without a plus sign and leading zeros; fraction digits stay."""
    return F.regexp_replace(F.regexp_replace(c, r"\A\+", ""), r"\A(-?)0+(?=[0-9])", "$1")


def datetime_text(c: Column) -> Column:
    """UTC text with seconds, or microseconds where there are any."""
    fraction = F.date_format(c, "SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))


def target_scalar(c: Column, kind: str) -> Column:
    """A target's text: ``False`` stands for null except in booleans."""
    cleaned = c if kind == "boolean" else F.when(~F.lower(c).isin("false", ""), c)
    return parse(cleaned, kind)


# ---------------------------------------------------------------- validations: true where the value is wrong


def wrong_length(c: Column, n: int) -> Column:
    return F.char_length(c) != n


CLASSES = {"digits": "[0-9]", "uppercase": "[A-Z]", "lowercase": "[a-z]"}


def wrong_characters(c: Column, kind: str, segment: str = "entire", n: int = 0) -> Column:
    """ASCII digits, upper- or lower-case letters only, in all of the text or its first or last n characters; shorter is wrong."""
    if segment == "entire":
        return ~c.rlike(rf"\A{CLASSES[kind]}+\z")
    part = F.left(c, F.lit(n)) if segment == "first" else F.right(c, F.lit(n))
    return (F.char_length(c) < n) | ~part.rlike(rf"\A{CLASSES[kind]}+\z")


def wrong_pattern(c: Column, pattern: str) -> Column:
    """The whole text must match a guarded pattern."""
    from tidemark.functions.text import guarded_pattern

    return ~c.rlike(rf"\A(?:{guarded_pattern(pattern)})\z")
