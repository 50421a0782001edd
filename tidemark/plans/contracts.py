"""Declarations of a preparation plan: immutable, without a Spark import."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TextStep:
    """``kind``: literal, prefix, suffix, pattern or separators (between digits)."""

    kind: str
    search: str
    replacement: str = ""
    every: bool = True


@dataclass(frozen=True)
class Check:
    """``kind``: exact_length (n), characters (what, segment, n) or pattern (what)."""

    kind: str
    what: str = ""
    n: int = 0
    segment: str = "entire"


@dataclass(frozen=True)
class Condition:
    """One of the selection predicates on a source column; ``kind`` is the operand's type."""

    column: str
    op: str
    value: str | None = None
    kind: str = "string"


@dataclass(frozen=True)
class Rule:
    """Ordered selection rule: its value is taken when all (or any) conditions hold."""

    conditions: tuple[Condition, ...]
    value: str
    join: str = "all"


@dataclass(frozen=True)
class FieldSpec:
    """One target field: where its text comes from and what becomes of it.

    ``provider``: source, constant, fallback (source, else ``constant``), selection
    (``rules``, else ``otherwise``), formula or omit.
    """

    name: str
    provider: str = "source"
    source: str | None = None
    constant: str | None = None
    rules: tuple[Rule, ...] = ()
    otherwise: str | None = None
    formula: str | None = None
    kind: str = "string"
    strip: bool = True
    squeeze: bool = False
    case: str = "keep"
    steps: tuple[TextStep, ...] = ()
    value_map: tuple[tuple[str, str], ...] = ()
    required: bool = False
    required_on_create: bool = False
    locale: str = "invariant"
    form: str = "iso"
    places: int | None = None
    rounding: str = "half_up"
    checks: tuple[Check, ...] = ()


@dataclass(frozen=True)
class RelationSpec:
    """A reference of a dataset's rows to another dataset (``origin`` incoming) or to the target."""

    name: str
    parent: str
    key: tuple[str, ...]
    origin: str = "incoming"
    required_at_create: bool = True
    on_missing: str = "block"
    kind: str = "many2one"  # or many2many


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    identity: tuple[str, ...]
    fields: tuple[FieldSpec, ...]
    scope: tuple[str, ...] = ()
    relations: tuple[RelationSpec, ...] = ()
    create_policy: str = "create"  # or block, or create_only (existing rows stay)
    unique_row: str = "src_row"


@dataclass(frozen=True)
class QualityRule:
    """``kind``: required_if, exactly_one_of, ordered, equal, unequal, luhn, iban, postal, date_window, metric or outlier."""

    code: str
    kind: str
    columns: tuple[str, ...]
    policy: str = "quarantine"  # block, quarantine, exclude or warning
    options: tuple[tuple[str, str], ...] = ()

    def option(self, name: str, default=None):
        return dict(self.options).get(name, default)


@dataclass(frozen=True)
class ResolutionRule:
    """Fuzzy candidates: blocking columns, compared columns with method and weight, threshold."""

    name: str
    block: tuple[str, ...]
    compare: tuple[tuple[str, str, float], ...]  # column, levenshtein or jaccard, weight
    threshold: float = 0.85
    max_block: int = 50
    max_degree: int = 5


@dataclass(frozen=True)
class ControlTotal:
    """What the exact sum of a numeric field has to be, within a tolerance."""

    dataset: str
    field: str
    expected: str | None = None
    tolerance: str = "0"


@dataclass(frozen=True)
class Plan:
    datasets: tuple[DatasetSpec, ...]
    quality: tuple[QualityRule, ...] = field(default=())
