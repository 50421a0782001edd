"""Field declarations compiled to Columns: prepared text, typed value and the first error of every field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import convert, text
from tidemark.functions.formula import formula
from tidemark.plans.contracts import Condition, DatasetSpec, FieldSpec, Rule

#: Above so many pairs a value map is joined, not looked up in a literal.
MAP_LITERAL = 50


def condition(c: Condition) -> Column:
    """A selection predicate; a blank operand is false for all but the blank tests."""
    raw = F.col(f"`{c.column}`").cast("string")
    blank = text.is_blank(raw)
    if c.op == "is_blank":
        return blank
    if c.op == "is_not_blank":
        return ~blank
    value = text.trim(raw)
    if c.kind == "string":
        other = F.lit(c.value)
        test = {
            "equals": lambda: value == other,
            "not_equals": lambda: value != other,
            "equals_ignore_case": lambda: text.casefold(value) == text.casefold(other),
            "contains": lambda: value.contains(other),
            "starts_with": lambda: value.startswith(other),
            "ends_with": lambda: value.endswith(other),
        }[c.op]()
    else:
        typed = convert.parse(value, c.kind)
        if c.op in ("is_true", "is_false"):
            test = typed if c.op == "is_true" else ~typed
        else:
            other = convert.parse(F.lit(c.value), c.kind)
            test = {"equals": lambda: typed == other, "not_equals": lambda: typed != other, "lt": lambda: typed < other, "le": lambda: typed <= other, "gt": lambda: typed > other, "ge": lambda: typed >= other}[c.op]()
    return ~blank & F.coalesce(test, F.lit(False))


def condition_invalid(c: Condition) -> Column:
    """An operand that isn't blank and isn't of its type."""
    if c.kind == "string" or c.op in ("is_blank", "is_not_blank"):
        return F.lit(False)
    raw = F.col(f"`{c.column}`").cast("string")
    return ~text.is_blank(raw) & convert.parse(text.trim(raw), c.kind).isNull()


def rule_holds(rule: Rule) -> Column:
    tests = [condition(c) for c in rule.conditions]
    out = tests[0]
    for t in tests[1:]:
        out = (out & t) if rule.join == "all" else (out | t)
    return out


def selected(rules: Sequence[Rule], otherwise: str | None) -> tuple[Column, Column, Column]:
    """Value of the first rule that holds, whether an operand is invalid, whether no rule and no default decides."""
    value = F.when(F.lit(False), F.lit(None).cast("string"))
    invalid, any_ = F.lit(False), F.lit(False)
    for rule in rules:
        holds = rule_holds(rule)
        value = value.when(holds, F.lit(rule.value))
        any_ = any_ | holds
        for c in rule.conditions:
            invalid = invalid | condition_invalid(c)
    return value.otherwise(F.lit(otherwise)), invalid, (~any_ if otherwise is None else F.lit(False))


def rule_overlap(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """How many rules hold, and the number (from 1) of the first."""
    holds = [rule_holds(r) for r in rules]
    first = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, h in enumerate(holds, 1):
        first = first.when(h, F.lit(i))
    return sum((h.cast("int") for h in holds), F.lit(0)), first


def _steps(c: Column, f: FieldSpec, authored: bool = True) -> Column:
    out = text.trim(c) if f.strip else c
    out = text.collapse(out) if f.squeeze else out
    for s in f.steps if authored else ():
        out = {
            "literal": lambda x, s=s: text.replace_literal(x, s.search, s.replacement, s.every),
            "prefix": lambda x, s=s: text.replace_prefix(x, s.search, s.replacement),
            "suffix": lambda x, s=s: text.replace_suffix(x, s.search, s.replacement),
            "pattern": lambda x, s=s: text.replace_pattern(x, s.search, s.replacement, s.every),
            "separators": lambda x, s=s: text.remove_separators_between_digits(x, s.search),
        }[s.kind](out)
    return text.change_case(out, f.case)


def _given(f: FieldSpec) -> dict[str, Column]:
    """The provider's text, and whether an operand is invalid, no rule decides, the fallback is used."""
    out = {"invalid": F.lit(False), "undecided": F.lit(False), "fallback": F.lit(False)}
    raw = F.col(f"`{f.source}`").cast("string") if f.source else F.lit(None).cast("string")
    if f.provider == "constant":
        out["given"] = F.lit(f.constant)
    elif f.provider == "fallback":
        probe = text.empty_as_null(_steps(raw, f, authored=False))
        out["fallback"] = probe.isNull()
        out["given"] = F.when(probe.isNull(), F.lit(f.constant)).otherwise(raw)
    elif f.provider == "selection":
        out["given"], out["invalid"], out["undecided"] = selected(f.rules, f.otherwise)
    elif f.provider == "formula":
        names = {n: (F.col(f"`{n}`").cast("string"), "text") for n in _names(f.formula or "")}
        out["given"] = formula(f.formula or "", names).cast("string")
    else:
        out["given"] = raw
    return out


def _prepared(f: FieldSpec, given: Column, done: Column) -> Column:
    prepared = text.empty_as_null(done)
    if f.value_map:  # on the stripped raw text; a hit goes past the text steps
        table = F.create_map(*[F.lit(x) for pair in f.value_map for x in pair])
        prepared = F.coalesce(F.try_element_at(table, text.trim(given)), prepared)
    return prepared


def _typed(f: FieldSpec, prepared: Column) -> Column:
    value = convert.parse(prepared, f.kind, f.locale, f.form)
    return convert.round_decimal(value, f.places, f.rounding) if f.kind == "decimal" and f.places is not None else value


def _error(f: FieldSpec, long: Column, invalid: Column, undecided: Column, prepared: Column, value: Column) -> Column:
    error = F.when(long, F.lit("SOURCE_RULE_OUTPUT_TOO_LONG")).when(invalid, F.lit("SOURCE_SELECTION_RULE_SOURCE_INVALID")).when(undecided, F.lit("SOURCE_SELECTION_RULE_UNRESOLVED"))
    if f.required:
        error = error.when(prepared.isNull(), F.lit("SOURCE_REQUIRED_VALUE_MISSING"))
    error = error.when(prepared.isNotNull() & value.isNull(), F.lit("SOURCE_TYPE_INVALID"))
    for c in f.checks:
        wrong, code = {
            "exact_length": lambda c=c: (convert.wrong_length(prepared, c.n), "SOURCE_TEXT_LENGTH_INVALID"),
            "characters": lambda c=c: (convert.wrong_characters(prepared, c.what, c.segment, c.n), "SOURCE_TEXT_SEGMENT_INVALID"),
            "pattern": lambda c=c: (convert.wrong_pattern(prepared, c.what), "SOURCE_PATTERN_MISMATCH"),
        }[c.kind]()
        error = error.when(wrong, F.lit(code))
    return error


def _long(f: FieldSpec, done: Column) -> Column:
    return F.coalesce(text.too_long(done), F.lit(False)) if f.steps or f.formula else F.lit(False)


def compile_field(f: FieldSpec) -> dict[str, Column]:
    """``prepared`` (text), ``value`` (typed), ``fallback`` (flag) and ``error`` (code or null) of one field.

    The error is the first of: text too long, selection operand invalid, selection
    undecided, required text missing, conversion, checks in order, required value missing.
    """
    g = _given(f)
    done = _steps(g["given"], f)
    prepared = _prepared(f, g["given"], done)
    value = _typed(f, prepared)
    return {"prepared": prepared, "value": value, "fallback": g["fallback"], "error": _error(f, _long(f, done), g["invalid"], g["undecided"], prepared, value)}


def _names(expression: str) -> list[str]:
    import ast

    from tidemark.functions.formula import FUNCTIONS

    return sorted({n.id for n in ast.walk(ast.parse(expression, mode="eval")) if isinstance(n, ast.Name)} - set(FUNCTIONS))


def issue_array(errors: Mapping[str, Column]) -> Column:
    """Array of (kind, idx, error) of the fields with an error, in field order."""
    return F.array_compact(F.array(*[F.when(e.isNotNull(), F.struct(F.lit("field").alias("kind"), F.lit(i).alias("idx"), e.alias("error"))) for i, e in enumerate(errors.values())]))


def prepare(df: DataFrame, spec: DatasetSpec, keep: Sequence[str] = ()) -> DataFrame:
    """One narrow stage: ``keep``, each field's value, its prepared text ``<name>__text`` and ``issues``.

    Each step is a projection on the one before, so that a text that later steps need
    several times is computed once.
    """
    fields = [f for f in spec.fields if f.provider != "omit"]
    kept = [F.col(f"`{c}`").alias(f"k{i}__") for i, c in enumerate(keep)]
    again = [F.col(f"k{i}__") for i in range(len(keep))]
    first = [(f"{part}{i}__", c) for i, f in enumerate(fields) for part, c in _given(f).items()]
    cur = df.select(*kept, *[c.alias(n) for n, c in first])
    flags = [F.col(n) for n, _ in first if not n.startswith("given")]
    cur = cur.select(*again, *flags, *[F.col(f"given{i}__") for i in range(len(fields))], *[_steps(F.col(f"given{i}__"), f).alias(f"done{i}__") for i, f in enumerate(fields)])
    cur = cur.select(*again, *flags, *[_prepared(f, F.col(f"given{i}__"), F.col(f"done{i}__")).alias(f"text{i}__") for i, f in enumerate(fields)], *[_long(f, F.col(f"done{i}__")).alias(f"long{i}__") for i, f in enumerate(fields)])
    cur = cur.select("*", *[_typed(f, F.col(f"text{i}__")).alias(f"value{i}__") for i, f in enumerate(fields)])
    errors = {f.name: _error(f, *[F.col(f"{part}{i}__") for part in ("long", "invalid", "undecided", "text", "value")]) for i, f in enumerate(fields)}
    cur = cur.select("*", *[e.alias(f"error{i}__") for i, e in enumerate(errors.values())])
    return cur.select(
        *[F.col(f"k{i}__").alias(c) for i, c in enumerate(keep)],
        *[F.col(f"value{i}__").alias(f.name) for i, f in enumerate(fields)],
        *[F.col(f"text{i}__").alias(f"{f.name}__text") for i, f in enumerate(fields)],
        *[F.col(f"fallback{i}__").alias(f"{f.name}__fallback") for i, f in enumerate(fields) if f.provider == "fallback"],
        issue_array({f.name: F.col(f"error{i}__") for i, f in enumerate(fields)}).alias("issues"),
    )


def map_by_join(df: DataFrame, column: str, pairs: DataFrame, out: str) -> DataFrame:
    """A large value map as a join; ``pairs``: from_value, to_value, at most one row for each from_value."""
    left = df.withColumn("key__", text.trim(F.col(f"`{column}`").cast("string")))
    return left.join(pairs.select(F.col("from_value").alias("key__"), F.col("to_value").alias(out)), "key__", "left").drop("key__")


def out_of_domain(value: Column, codes: Sequence[str]) -> Column:
    """A value that isn't null and isn't among a field's live codes."""
    return value.isNotNull() & ~value.isin(list(codes))


def required_on_create(spec: DatasetSpec, matched: Column) -> Column:
    """Names of the fields that a new row lacks."""
    lacks = [F.when(~matched & F.col(f"`{f.name}`").isNull(), F.lit(f.name)) for f in spec.fields if f.required_on_create]
    return F.array_compact(F.array(*lacks)) if lacks else F.array().cast("array<string>")
