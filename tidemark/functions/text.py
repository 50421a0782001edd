"""Text functions as Column builders.  White space is Unicode white space unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"
MAX_OUTPUT = 1_000_000


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Fixed value: the white space characters.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Without white space at either end; looks at the ends only, not at the whole text."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse(c: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, rf"(?U){_SPACE}+", " ")


def empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim(c) == "")


def replace_literal(c: Column, search: str, replacement: str, every: bool = True) -> Column:
    """All occurrences of a substring, or the first one."""
    if not search:
        return c
    if every:
        return F.replace(c, F.lit(search), F.lit(replacement))
    at = F.instr(c, search)
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.lit(replacement), F.substr(c, at + len(search)))).otherwise(c)


def replace_prefix(c: Column, prefix: str, replacement: str) -> Column:
    return F.when(c.startswith(prefix), F.concat(F.lit(replacement), F.substr(c, F.lit(len(prefix) + 1)))).otherwise(c)


def replace_suffix(c: Column, suffix: str, replacement: str) -> Column:
    return F.when(c.endswith(suffix), F.concat(F.left(c, F.char_length(c) - len(suffix)), F.lit(replacement))).otherwise(c)


class UnsafePattern(ValueError):
    """A pattern that may take exponential time or that engines read differently."""


def guarded_pattern(pattern: str) -> str:
    """The pattern, if it has at most 500 characters and 50 groups, no back-reference, look-around or nested quantifier."""
    if len(pattern) > 500:
        raise UnsafePattern("longer than 500 characters")
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        raise UnsafePattern(str(e)) from e
    if compiled.groups > 50:
        raise UnsafePattern("more than 50 groups")
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]|\(\?P=|\(\?(?:=|!|<=|<!|\()", pattern):
        raise UnsafePattern("back-references, look-around and conditions aren't allowed")
    if re.search(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)\s*[+*{]", pattern):
        raise UnsafePattern("a repeated group holds a repetition")
    return pattern


def replace_pattern(c: Column, pattern: str, replacement: str, every: bool = True) -> Column:
    """Matches of a guarded pattern; ``\\1`` in the replacement is a group."""
    java = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
    guarded = guarded_pattern(pattern)
    if every:
        return F.regexp_replace(c, guarded, java)
    # only the first: what follows it is matched and put back
    return F.regexp_replace(c, rf"(?s)\A(?<tmhead>.*?)(?:{guarded})(?<tmtail>.*)\z", "${tmhead}" + _shift(java) + "${tmtail}")


def _shift(java: str) -> str:
    """Group numbers behind one more group at the start."""
    return re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 1}", java)


def remove_separators_between_digits(c: Column, characters: str) -> Column:
    """Runs of these characters vanish where an ASCII digit stands on both sides."""
    return F.regexp_replace(c, f"(?<=[0-9])[{re.escape(characters)}]+(?=[0-9])", "")


def sentence_case(c: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    at = F.regexp_instr(c, F.lit(r"\p{L}"))
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.upper(F.substr(c, at, F.lit(1))), F.substr(c, at + 1))).otherwise(c)


def title_case(c: Column) -> Column:
    """Letters after a non-letter in upper case, other letters in lower case."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("inside"))

    def step(acc, ch):
        letter = ch.rlike(r"\p{L}")
        return F.struct(F.concat(acc["out"], F.when(~letter, ch).when(acc["inside"], F.lower(ch)).otherwise(F.upper(ch))).alias("out"), letter.alias("inside"))

    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(F.aggregate(F.split(c, ""), start, step)["out"])


def change_case(c: Column, mode: str) -> Column:
    return {"upper": F.upper, "lower": F.lower, "sentence": sentence_case, "title": title_case, "keep": lambda x: x}[mode](c)


def too_long(c: Column, limit: int = MAX_OUTPUT) -> Column:
    return F.char_length(c) > limit


def casefold(c: Column) -> Column:
    """Lower case with final sigma and sharp s written out: what differs in case only becomes equal."""
    return F.replace(F.translate(F.lower(c), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def normalized(c: Column, strip: bool = True, squeeze: bool = False, fold: bool = False, blank_null: bool = True) -> Column:
    """Profile normalisation: strip, collapse, fold case, empty to null, in this order."""
    out = trim(c) if strip else c
    out = collapse(out) if squeeze else out
    out = casefold(out) if fold else out
    return empty_as_null(out) if blank_null else out


def nfkc(c: Column) -> Column:
    """Compatibility composition.  ASCII is unchanged and stays in the JVM; other text takes a UDF over Arrow."""
    import unicodedata

    composed = F.udf(lambda v: None if v is None else unicodedata.normalize("NFKC", v), "string", useArrow=True)
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed(c)).otherwise(c)


def normalized_key(c: Column, unicode: bool = True) -> Column:
    """Key text: compatibility-composed, white space collapsed and stripped, blank to null."""
    return empty_as_null(trim(collapse(nfkc(c) if unicode else c)))


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def fuzzy_text(c: Column, unicode: bool = False) -> Column:
    """Comparison text: composed, case-folded, punctuation to space, collapsed."""
    out = casefold(nfkc(c) if unicode else c)
    return trim(collapse(F.translate(out, PUNCTUATION, " " * len(PUNCTUATION))))


def path_parts(c: Column, separator: str, unicode: bool = False) -> Column:
    """Parts of a hierarchical path; null if the value or any part is blank."""
    parts = F.transform(F.split(nfkc(c) if unicode else c, re.escape(separator)), lambda p: trim(collapse(p)))
    return let(parts, lambda p: F.when(F.exists(p, lambda x: x == "") | p.isNull(), F.lit(None).cast("array<string>")).otherwise(p))


def split_list(c: Column, separator: str) -> Column:
    """Struct (items, blank, duplicate): distinct items in order, and whether items were blank or came twice."""
    parts = F.transform(F.split(c, re.escape(separator)), trim)
    return F.when(is_blank(c), F.struct(F.array().cast("array<string>").alias("items"), F.lit(False).alias("blank"), F.lit(False).alias("duplicate"))).otherwise(
        let(
            parts,
            lambda p: F.struct(
                F.array_distinct(F.filter(p, lambda x: x != "")).alias("items"),
                F.exists(p, lambda x: x == "").alias("blank"),
                (F.size(F.array_distinct(F.filter(p, lambda x: x != ""))) < F.size(F.filter(p, lambda x: x != ""))).alias("duplicate"),
            ),
        )
    )


def joined_display(parts: list[Column], separator: str = " | ") -> Column:
    """Parts in one text; null is shown as a dash."""
    return F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("—")) for p in parts])


def record_label(parts: list[Column], row: Column, width: int = 120) -> Column:
    """The first two identity values that aren't blank, or the row's number."""
    some = F.slice(F.filter(F.array(*[p.cast("string") for p in parts]), lambda x: x.isNotNull() & (trim(x) != "")), 1, 2)
    return let(some, lambda s: F.when(F.size(s) > 0, F.left(F.array_join(s, " / "), F.lit(width))).otherwise(F.concat(F.lit("Row "), row.cast("string"))))


def masked(c: Column, restricted: bool, shown: str = "Hidden") -> Column:
    """A restricted value's display."""
    return F.when(c.isNotNull(), F.lit(shown)) if restricted else c


def formula_safe(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(c.rlike(r"\A[\t\r\n ]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
