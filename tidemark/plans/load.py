"""Plans from plain dictionaries (JSON or YAML), strictly: unknown keys are errors."""

from __future__ import annotations

import json
import types
import typing
from dataclasses import fields, is_dataclass

from tidemark.plans.contracts import Plan


class PlanError(ValueError):
    """A document that isn't a plan."""


def from_dict(kind, data, where: str = "plan"):
    """An instance of a contract dataclass from nested dictionaries and lists."""
    if not isinstance(data, dict):
        raise PlanError(f"{where}: a mapping is needed")
    hints = typing.get_type_hints(kind)
    unknown = sorted(set(data) - {f.name for f in fields(kind)})
    if unknown:
        raise PlanError(f"{where}: unknown keys {', '.join(unknown)}")
    try:
        return kind(**{k: _value(hints[k], v, f"{where}.{k}") for k, v in data.items()})
    except TypeError as e:
        raise PlanError(f"{where}: {e}") from e


def _value(hint, value, where: str):
    origin = typing.get_origin(hint)
    if origin is types.UnionType:
        if value is None:
            return None
        return _value(next(a for a in typing.get_args(hint) if a is not type(None)), value, where)
    if origin is tuple:
        if not isinstance(value, list | tuple):
            raise PlanError(f"{where}: a list is needed")
        args = typing.get_args(hint)
        kinds = [args[0]] * len(value) if args[-1] is Ellipsis else list(args)
        if len(kinds) != len(value):
            raise PlanError(f"{where}: {len(kinds)} items are needed")
        return tuple(_value(k, v, f"{where}[{i}]") for i, (k, v) in enumerate(zip(kinds, value, strict=True)))
    if is_dataclass(hint):
        return from_dict(hint, value, where)
    if hint is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, hint) or isinstance(value, bool) != (hint is bool):
        raise PlanError(f"{where}: {value!r} is no {hint.__name__}")
    return value


def load_plan(text: str) -> Plan:
    """A plan from JSON, or from YAML where a YAML reader is installed."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise PlanError("not JSON, and no YAML reader is installed") from e
        data = yaml.safe_load(text)
    return from_dict(Plan, data)
