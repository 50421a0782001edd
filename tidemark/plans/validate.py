"""Plan-time checks, before any Spark job.  Each problem is (code, where, what)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from decimal import Decimal, InvalidOperation

from tidemark.functions.convert import DATES, DATETIMES, LOCALES, ROUNDINGS
from tidemark.functions.formula import FormulaError, parse_formula
from tidemark.functions.text import UnsafePattern, guarded_pattern
from tidemark.plans.contracts import ControlTotal, DatasetSpec, FieldSpec, Plan

KINDS = ("string", "integer", "decimal", "boolean", "date", "datetime")
MAX_RULES, MAX_CONDITIONS, MAX_VALUE_MAP = 20, 8, 1000
TEXT_OPS = ("is_blank", "is_not_blank", "equals", "not_equals", "equals_ignore_case", "contains", "starts_with", "ends_with")
ORDER_OPS = ("equals", "not_equals", "lt", "le", "gt", "ge")
BOOLEAN_OPS = ("is_true", "is_false")
#: Target field type -> kinds that it takes.
COMPATIBLE = {
    "char": {"string"}, "text": {"string"}, "html": {"string"}, "selection": {"string"}, "integer": {"integer"}, "float": {"decimal", "integer"},
    "monetary": {"decimal", "integer"}, "boolean": {"boolean"}, "date": {"date"}, "datetime": {"datetime"},
}


def topological(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[str]:
    """Order in which (before, after) holds, lexicographic among the free; raises ValueError with the nodes of a cycle."""
    left = {n: set() for n in nodes}
    for before, after in edges:
        if before in left and after in left and before != after:
            left[after].add(before)
    out: list[str] = []
    while left:
        free = sorted(n for n, needs in left.items() if not needs)
        if not free:
            raise ValueError(f"cycle among {', '.join(sorted(left))}")
        out.append(free[0])
        del left[free[0]]
        for needs in left.values():
            needs.discard(free[0])
    return out


def validate(plan: Plan, columns: Mapping[str, Iterable[str]], target: Mapping[str, Mapping[str, dict]] | None = None) -> list[tuple[str, str, str]]:
    """Problems of a plan, given each dataset's source columns and, where known, the target's fields (type, required, readonly)."""
    out: list[tuple[str, str, str]] = []
    names = [d.name for d in plan.datasets]
    identities = {d.name: len(d.identity) + len(d.scope) for d in plan.datasets}
    out += [("DATASET_DUPLICATE", n, "declared twice") for n in sorted({n for n in names if names.count(n) > 1})]
    for d in plan.datasets:
        if d.name not in columns:
            out.append(("DATASET_UNKNOWN", d.name, "no such source"))
            continue
        out += _dataset(d, set(columns[d.name]), names, identities)
        if target is not None:
            out += _target(d, target)
    try:
        topological(names, [(r.parent, d.name) for d in plan.datasets for r in d.relations if r.origin == "incoming" and r.required_at_create])
    except ValueError as e:
        out.append(("DEPENDENCY_CYCLE", "plan", str(e)))
    return out


def _dataset(d: DatasetSpec, have: set[str], names: list[str], identities: Mapping[str, int]) -> list[tuple[str, str, str]]:
    out = []
    fields = [f.name for f in d.fields]
    out += [("TARGET_FIELD_CLAIMED_TWICE", f"{d.name}.{n}", "two fields write it") for n in sorted({n for n in fields if fields.count(n) > 1})]
    if not d.identity:
        out.append(("IDENTITY_MISSING", d.name, "no identity"))
    if len(set(d.identity)) < len(d.identity):
        out.append(("IDENTITY_REPEATED", d.name, "a component comes twice"))
    for part in (*d.identity, *d.scope):
        if part not in fields:
            out.append(("IDENTITY_UNMAPPED", f"{d.name}.{part}", "not among the fields"))
    if d.create_policy not in ("create", "block", "create_only"):
        out.append(("CREATE_POLICY_UNKNOWN", d.name, d.create_policy))
    for r in d.relations:
        if r.origin == "incoming" and r.parent not in names:
            out.append(("RELATION_PARENT_UNKNOWN", f"{d.name}.{r.name}", r.parent))
        if r.origin not in ("incoming", "target"):
            out.append(("RELATION_ORIGIN_UNKNOWN", f"{d.name}.{r.name}", r.origin))
        if r.kind not in ("many2one", "many2many"):
            out.append(("RELATION_KIND_UNKNOWN", f"{d.name}.{r.name}", r.kind))
        if r.origin == "incoming" and r.parent in identities and len(r.key) != identities[r.parent]:
            out.append(("RELATION_KEY_ARITY", f"{d.name}.{r.name}", f"{len(r.key)} fields for an identity of {identities[r.parent]}"))
        if r.on_missing in ("null", "warning") and r.required_at_create:
            out.append(("RELATION_POLICY_UNSAFE", f"{d.name}.{r.name}", f"{r.on_missing} for a reference that a new row needs"))
        if not r.key or any(k not in fields for k in r.key):
            out.append(("RELATION_KEY_UNMAPPED", f"{d.name}.{r.name}", ", ".join(r.key)))
        if r.on_missing not in ("block", "null", "warning"):
            out.append(("RELATION_POLICY_UNKNOWN", f"{d.name}.{r.name}", r.on_missing))
    for f in d.fields:
        out += [(code, f"{d.name}.{f.name}", what) for code, what in _field(f, have)]
    return out


def _field(f: FieldSpec, have: set[str]):
    if f.kind not in KINDS:
        yield "KIND_UNKNOWN", f.kind
    if f.provider in ("source", "fallback") and f.source not in have:
        yield "SOURCE_FIELD_MISSING", str(f.source)
    if f.provider in ("constant", "fallback") and f.constant is None:
        yield "CONSTANT_MISSING", "no constant"
    if f.provider == "selection":
        if not f.rules or len(f.rules) > MAX_RULES:
            yield "SELECTION_RULES_BOUND", f"1 to {MAX_RULES} rules"
        for r in f.rules:
            if not r.conditions or len(r.conditions) > MAX_CONDITIONS or r.join not in ("all", "any"):
                yield "SELECTION_CONDITIONS_BOUND", f"1 to {MAX_CONDITIONS} conditions, joined by all or any"
            for c in r.conditions:
                if c.column not in have:
                    yield "SOURCE_FIELD_MISSING", c.column
                allowed = TEXT_OPS if c.kind == "string" else ("is_blank", "is_not_blank", *(BOOLEAN_OPS if c.kind == "boolean" else ORDER_OPS))
                if c.op not in allowed:
                    yield "SELECTION_OPERATOR_INCOMPATIBLE", f"{c.op} on {c.kind}"
    if f.provider == "formula":
        try:
            from pyspark.sql import functions as F

            parse_formula(f.formula or "", {n: (F.col(f"`{n}`"), "text") for n in have} if _session() else _NoColumns(have))
        except FormulaError as e:
            yield "SOURCE_FORMULA_INVALID", str(e)
    if len(f.value_map) > MAX_VALUE_MAP or len({k for k, _ in f.value_map}) < len(f.value_map):
        yield "VALUE_MAP_INVALID", f"at most {MAX_VALUE_MAP} distinct values"
    if f.locale not in LOCALES:
        yield "LOCALE_UNKNOWN", f.locale
    if f.kind == "date" and f.form not in DATES or f.kind == "datetime" and f.form not in ("iso", *DATETIMES):
        yield "FORMAT_UNKNOWN", f.form
    if f.rounding not in ROUNDINGS:
        yield "ROUNDING_UNKNOWN", f.rounding
    if f.checks and f.kind != "string":
        yield "SOURCE_VALUE_RULE_INVALID", "text checks on a value that isn't text"
    for pattern in [s.search for s in f.steps if s.kind == "pattern"] + [c.what for c in f.checks if c.kind == "pattern"]:
        try:
            guarded_pattern(pattern)
        except UnsafePattern as e:
            yield "PATTERN_UNSAFE", str(e)


class _NoColumns(dict):
    """Names without a session: only the formula's shape can be checked."""

    def __init__(self, names):
        super().__init__({n: None for n in names})

    def __getitem__(self, name):
        raise FormulaError(f"formula on {name!r} can't be checked without a session")


def _session() -> bool:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() is not None


def _target(d: DatasetSpec, target: Mapping[str, Mapping[str, dict]]) -> list[tuple[str, str, str]]:
    if d.name not in target:
        return [("TARGET_MODEL_UNKNOWN", d.name, "not in the target")]
    out, fields = [], target[d.name]
    for f in d.fields:
        if f.provider == "omit":
            continue
        meta = fields.get(f.name)
        if meta is None:
            out.append(("TARGET_FIELD_UNKNOWN", f"{d.name}.{f.name}", "not in the target"))
        elif meta.get("readonly"):
            out.append(("TARGET_FIELD_READONLY", f"{d.name}.{f.name}", "read only"))
        elif meta.get("type") in COMPATIBLE and f.kind not in COMPATIBLE[meta["type"]]:
            out.append(("TARGET_TYPE_INCOMPATIBLE", f"{d.name}.{f.name}", f"{f.kind} into {meta['type']}"))
    for r in d.relations:
        related = fields.get(r.name, {}).get("relation")
        if related is not None and related != r.parent:
            out.append(("RELATION_MODEL_MISMATCH", f"{d.name}.{r.name}", f"{r.parent}, not {related}"))
        if r.name in fields and fields[r.name].get("type", r.kind) != r.kind:
            out.append(("RELATION_KIND_MISMATCH", f"{d.name}.{r.name}", f"{r.kind} into {fields[r.name]['type']}"))
    mapped = {f.name for f in d.fields}
    out += [("TARGET_REQUIRED_UNMAPPED", f"{d.name}.{n}", "required and not mapped") for n, m in sorted(fields.items()) if m.get("required") and n not in mapped]
    return out


def recommend_key(curated: Mapping[str, tuple[str, ...]], model: str, unique: list[tuple[str, ...]], usable: set[str]) -> tuple[str, ...] | None:
    """A model's curated key, or its only unique definition on usable fields."""
    if model in curated:
        return curated[model]
    fit = [u for u in unique if set(u) <= usable]
    return fit[0] if len(fit) == 1 else None


def write_collisions(claims: Iterable[tuple[str, str, str]]) -> list[tuple[str, str, tuple[str, ...]]]:
    """(model, field, owners) claimed by more than one owner, from (owner, model, field)."""
    by: dict[tuple[str, str], set[str]] = {}
    for owner, model, name in claims:
        by.setdefault((model, name), set()).add(owner)
    return [(m, f, tuple(sorted(o))) for (m, f), o in sorted(by.items()) if len(o) > 1]


def union_requirements(requests: Iterable[tuple[str, Iterable[str]]]) -> dict[str, tuple[str, ...]]:
    """Per model, the union of the fields asked for."""
    out: dict[str, set[str]] = {}
    for model, fields in requests:
        out.setdefault(model, set()).update(fields)
    return {m: tuple(sorted(f)) for m, f in sorted(out.items())}


def code_drift(captured: Mapping[str, Iterable[str]], live: Mapping[str, Iterable[str]]) -> list[tuple[str, str, str]]:
    """Selection codes added to or removed from a field since it was captured."""
    out = []
    for name in sorted(captured):
        a, b = set(captured[name]), set(live.get(name, ()))
        out += [("TARGET_SELECTION_CHOICES_CHANGED", name, f"added {c}") for c in sorted(b - a)]
        out += [("TARGET_SELECTION_CHOICES_CHANGED", name, f"removed {c}") for c in sorted(a - b)]
    return out


def definition_hash(value) -> str:
    """SHA-256 of a selection of columns or of a target's fields, whatever the order of its parts."""

    def plain(v):
        if isinstance(v, Mapping):
            return {str(k): plain(x) for k, x in v.items()}
        return v if isinstance(v, str | int | float | bool | None) else sorted(map(str, v))

    return hashlib.sha256(json.dumps(plain(value), sort_keys=True).encode()).hexdigest()


def binding_problems(bound: tuple[str, str], columns: Mapping[str, Iterable[str]], target: Mapping[str, Mapping[str, dict]]) -> list[tuple[str, str, str]]:
    """A plan is bound to the hashes (selection, schema) that it was made for; what differs now."""
    now = (definition_hash(columns), definition_hash(target))
    return [(code, "plan", f"{a} now") for code, a, b in zip(("SELECTION_HASH_MISMATCH", "SCHEMA_HASH_MISMATCH"), now, bound, strict=True) if a != b]


def deferred_checks(plan: Plan) -> list[tuple[str, str]]:
    """Checks that only rows can answer: (check, dataset and field)."""
    out = []
    for d in sorted(plan.datasets, key=lambda d: d.name):
        out.append(("IDENTITY_UNIQUE", d.name))
        out += [("REFERENCE_RESOLVES", f"{d.name}.{r.name}") for r in d.relations]
        out += [("REQUIRED_ON_CREATE_PRESENT", f"{d.name}.{f.name}") for f in d.fields if f.required_on_create]
        out += [("REQUIRED_PRESENT", f"{d.name}.{f.name}") for f in d.fields if f.required]
        out += [("CONVERSION_SUCCEEDS", f"{d.name}.{f.name}") for f in d.fields if f.kind != "string" and f.provider != "omit"]
    return out


def control_total_problems(plan: Plan, totals: Iterable[ControlTotal]) -> list[tuple[str, str, str]]:
    """A control total names a mapped numeric field once and says what to expect."""
    out, seen = [], set()
    fields = {(d.name, f.name): f for d in plan.datasets for f in d.fields}
    names = {d.name for d in plan.datasets}
    for t in totals:
        where = f"{t.dataset}.{t.field}"
        f = fields.get((t.dataset, t.field))
        if t.dataset not in names:
            out.append(("CONTROL_TOTAL_DATASET_UNKNOWN", where, t.dataset))
        elif f is None or f.provider == "omit":
            out.append(("CONTROL_TOTAL_FIELD_UNMAPPED", where, t.field))
        elif f.kind not in ("integer", "decimal"):
            out.append(("CONTROL_TOTAL_NOT_NUMERIC", where, f.kind))
        if (t.dataset, t.field) in seen:
            out.append(("CONTROL_TOTAL_REPEATED", where, "declared twice"))
        seen.add((t.dataset, t.field))
        for what, text in (("EXPECTATION", t.expected), ("TOLERANCE", t.tolerance)):
            try:
                value = Decimal(text) if text is not None else None
            except InvalidOperation:
                value = None
            if value is None or not value.is_finite() or what == "TOLERANCE" and value < 0:
                out.append((f"CONTROL_TOTAL_{what}_MISSING", where, str(text)))
    return out


def metadata_requests(plan: Plan) -> dict[str, tuple[str, ...]]:
    """The least that has to be known of each model: fields written, identities and scopes, and the keys that references are looked up by."""
    specs = {d.name: d for d in plan.datasets}
    requests = []
    for d in plan.datasets:
        requests.append((d.name, [f.name for f in d.fields if f.provider != "omit"] + [*d.identity, *d.scope] + [r.name for r in d.relations]))
        for r in d.relations:
            requests.append((r.parent, [*specs[r.parent].identity, *specs[r.parent].scope] if r.parent in specs else r.key))
    return union_requirements(requests)


def capabilities(plan: Plan, map_literal: int = 50) -> list[tuple[str, str, str, str]]:
    """(dataset, field, how, reason): NATIVE for a field that is expressions only, JOIN or REFUSED with a reason; a dataset has the worst of its fields under ``*``."""
    worst = {"NATIVE": 0, "JOIN": 1, "REFUSED": 2}
    out = []
    for d in sorted(plan.datasets, key=lambda d: d.name):
        found = []
        for f in d.fields:
            how, reason = "NATIVE", ""
            if len(f.value_map) > map_literal:
                how, reason = "JOIN", f"value map of {len(f.value_map)}"
            for pattern in [s.search for s in f.steps if s.kind == "pattern"] + [c.what for c in f.checks if c.kind == "pattern"]:
                try:
                    guarded_pattern(pattern)
                except UnsafePattern as e:
                    how, reason = "REFUSED", str(e)
            found.append((d.name, f.name, how, reason))
        out += sorted(found)
        out.append((d.name, "*", max((x[2] for x in found), key=worst.__getitem__, default="NATIVE"), ""))
    return out


def canonical_plan(plan: Plan) -> Plan:
    """Datasets and fields in a stable order."""
    from dataclasses import replace

    return replace(plan, datasets=tuple(replace(d, fields=tuple(sorted(d.fields, key=lambda f: f.name))) for d in sorted(plan.datasets, key=lambda d: d.name)))
