"""A closed formula language, parsed on the driver to a Column.

Names are columns or ``value``.  Arithmetic is decimal; text that looks like a number
is a number before it is used, so ``concat("007", "x")`` is ``7x``.  Division by zero is
null.  ``a if c else b``, comparison chains, ``and``/``or``/``not`` and the functions
concat, coalesce, substring, upper, lower, strip, length and abs are allowed.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import trim

MAX_CHARS, MAX_NODES = 1000, 100
DECIMAL = "decimal(38,12)"
NUMBER = r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"
FUNCTIONS = ("concat", "coalesce", "substring", "upper", "lower", "strip", "length", "abs")
_ALLOWED = (
    ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.Call, ast.Name, ast.Load, ast.Constant,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.USub, ast.UAdd, ast.Not, ast.And, ast.Or,
    ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE,
)


class FormulaError(ValueError):
    """A formula outside the language."""


class _Value:
    """A Column with its kind: number, text, boolean or unknown (text that may look like a number)."""

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind

    def number(self) -> Column:
        if self.kind == "boolean":
            raise FormulaError("a boolean is no number")
        return self.column if self.kind == "number" else F.when(self.column.rlike(NUMBER), self.column.try_cast(DECIMAL))

    def text(self) -> Column:
        if self.kind == "number":
            return plain_number(self.column)
        if self.kind == "boolean":
            return F.when(self.column, F.lit("True")).otherwise(F.lit("False"))
        number = F.when(self.column.rlike(NUMBER), plain_number(self.column.try_cast(DECIMAL)))
        return F.coalesce(number, self.column) if self.kind == "unknown" else self.column

    def truth(self) -> Column:
        if self.kind == "boolean":
            return F.coalesce(self.column, F.lit(False))
        if self.kind == "number":
            return F.coalesce(self.column != 0, F.lit(False))
        return F.coalesce(F.when(self.column.rlike(NUMBER), self.column.try_cast(DECIMAL) != 0).otherwise(self.column != ""), F.lit(False))


def plain_number(c: Column) -> Column:
    """A number's shortest text: no trailing zeros or point."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")


def parse_formula(text: str, names: Mapping[str, tuple[Column, str]]) -> _Value:
    """``names``: name -> (column, kind).  Raises FormulaError for anything outside the language."""
    if len(text) > MAX_CHARS:
        raise FormulaError(f"longer than {MAX_CHARS} characters")
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise FormulaError(str(e)) from e
    nodes = list(ast.walk(tree))
    if len(nodes) > MAX_NODES:
        raise FormulaError(f"more than {MAX_NODES} nodes")
    for node in nodes:
        if not isinstance(node, _ALLOWED):
            raise FormulaError(f"{type(node).__name__} isn't allowed")
    return _build(tree.body, names)


def formula(text: str, names: Mapping[str, tuple[Column, str]]) -> Column:
    """The formula's value: a decimal, a boolean or a text."""
    value = parse_formula(text, names)
    return value.text() if value.kind == "unknown" else value.column


def _build(node: ast.AST, names) -> _Value:
    if isinstance(node, ast.Constant):
        if node.value is None or isinstance(node.value, bytes | complex) or node.value is Ellipsis:
            raise FormulaError("constants are numbers, texts and booleans")
        if isinstance(node.value, bool):
            return _Value(F.lit(node.value), "boolean")
        if isinstance(node.value, int | float):
            return _Value(F.lit(str(node.value)).cast(DECIMAL), "number")
        return _Value(F.lit(node.value), "unknown")
    if isinstance(node, ast.Name):
        if node.id not in names:
            raise FormulaError(f"unknown name {node.id!r}")
        column, kind = names[node.id]
        return _Value(column.cast(DECIMAL) if kind == "number" else column, "unknown" if kind == "text" else kind)
    if isinstance(node, ast.BinOp):
        left, right = _build(node.left, names), _build(node.right, names)
        if "boolean" in (left.kind, right.kind):
            raise FormulaError("booleans have no arithmetic")
        if isinstance(node.op, ast.Add) and "number" not in (left.kind, right.kind):
            sum_ = (left.number() + right.number()).cast(DECIMAL)
            return _Value(F.coalesce(plain_number(sum_), F.concat(left.text(), right.text())), "unknown")
        a, b = left.number(), right.number()
        out = {
            ast.Add: lambda: a + b,
            ast.Sub: lambda: a - b,
            ast.Mult: lambda: a * b,
            ast.Div: lambda: F.try_divide(a, b),
            ast.Mod: lambda: F.try_mod(a, b),
        }[type(node.op)]()
        return _Value(out.cast(DECIMAL), "number")
    if isinstance(node, ast.UnaryOp):
        value = _build(node.operand, names)
        if isinstance(node.op, ast.Not):
            return _Value(~value.truth(), "boolean")
        return _Value(-value.number() if isinstance(node.op, ast.USub) else value.number(), "number")
    if isinstance(node, ast.BoolOp):
        parts = [_build(v, names).truth() for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if isinstance(node.op, ast.And) else (out | p)
        return _Value(out, "boolean")
    if isinstance(node, ast.Compare):
        values = [_build(v, names) for v in (node.left, *node.comparators)]
        out = None
        for a, op, b in zip(values, node.ops, values[1:], strict=False):
            test = _compare(a, op, b)
            out = test if out is None else out & test
        return _Value(out, "boolean")
    if isinstance(node, ast.IfExp):
        test, yes, no = _build(node.test, names), _build(node.body, names), _build(node.orelse, names)
        if yes.kind == no.kind:
            return _Value(F.when(test.truth(), yes.column).otherwise(no.column), yes.kind)
        return _Value(F.when(test.truth(), yes.text()).otherwise(no.text()), "unknown")
    if isinstance(node, ast.Call):
        return _call(node, names)
    raise FormulaError(f"{type(node).__name__} isn't allowed")


def _compare(a: _Value, op: ast.cmpop, b: _Value) -> Column:
    def by(x: Column, y: Column) -> Column:
        return {ast.Eq: x == y, ast.NotEq: x != y, ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]

    if "boolean" in (a.kind, b.kind):
        return F.coalesce(by(a.truth(), b.truth()), F.lit(False))
    if "number" in (a.kind, b.kind):
        return F.coalesce(by(a.number(), b.number()), F.lit(isinstance(op, ast.NotEq)))
    both = a.number().isNotNull() & b.number().isNotNull()
    return F.coalesce(F.when(both, by(a.number(), b.number())).otherwise(by(a.text(), b.text())), F.lit(False))


def _call(node: ast.Call, names) -> _Value:
    if not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS or node.keywords:
        raise FormulaError("only the language's functions may be called, by position")
    name, args = node.func.id, [_build(a, names) for a in node.args]
    counts = {"substring": (2, 3), "concat": (1, 99), "coalesce": (1, 99)}.get(name, (1, 1))
    if not counts[0] <= len(args) <= counts[1]:
        raise FormulaError(f"{name} takes other arguments")
    if name == "concat":
        return _Value(F.concat(*[F.coalesce(a.text(), F.lit("")) for a in args]), "text")
    if name == "coalesce":
        if all(a.kind == "number" for a in args):
            return _Value(F.coalesce(*[a.column for a in args]), "number")
        return _Value(F.coalesce(*[F.nullif(a.text(), F.lit("")) for a in args]), "unknown")
    if name == "abs":
        return _Value(F.abs(args[0].number()), "number")
    text = args[0].text()
    if name == "length":
        return _Value(F.char_length(text).cast(DECIMAL), "number")
    if name == "substring":
        start, size = args[1].number().cast("int"), F.char_length(text)
        first = F.when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(start)
        count = args[2].number().cast("int") if len(args) == 3 else size
        return _Value(F.substr(text, first + 1, F.greatest(count, F.lit(0))), "text")
    return _Value({"upper": F.upper, "lower": F.lower, "strip": trim}[name](text), "text")
