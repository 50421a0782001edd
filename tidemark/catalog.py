"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.queries import extra, more, products, relations, scans, values

_ALL: dict[str, tuple[Callable, str | None]] = {**relations.QUERIES, **values.QUERIES, **extra.QUERIES, **scans.QUERIES, **products.QUERIES, **more.QUERIES}


def queries() -> dict[str, Callable]:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
