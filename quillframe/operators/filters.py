"""Row filters: ``column op value`` conditions and expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.errors import UserError
from quillframe.functions.cells import lit, literal
from quillframe.functions.expressions import compile_expression, truthy
from quillframe.operators.binding import Bound

WORDS = ("contains", "startswith", "endswith")
SIGNS = ("!=", ">=", "<=", "=", ">", "<")


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: str


def parse_condition(text: str) -> Condition:
    """Word operators (with blanks around) first, then signs in a fixed order."""
    for word in WORDS:
        if m := re.search(rf"\s{word}\s", text, re.I):
            return _condition(text, text[: m.start()], word, text[m.end() :])
    for sign in SIGNS:
        left, found, right = text.partition(sign)
        if found:
            return _condition(text, left, sign, right)
    raise UserError(f"filter {text!r} has no operator")


def _condition(text: str, left: str, op: str, right: str) -> Condition:
    left, right = left.strip(), right.strip()
    if not left:
        raise UserError(f"filter {text!r} has no column")
    if len(right) >= 2 and right[0] == right[-1] and right[0] in "\"'":
        right = right[1:-1]
    return Condition(left, op, right)


def compile_condition(c: Condition, bound: Bound) -> Column:
    """A predicate that is never NULL.

    Comparisons order NULL before every value, but only ``!=`` is true of a
    NULL and a value; two NULLs are equal. Text operators see the emitted text.
    """
    field = bound.field(c.column)
    if c.op in WORDS:
        text = F.coalesce(field.text, F.lit(""))
        return {"contains": text.contains, "startswith": text.startswith, "endswith": text.endswith}[c.op](c.value)
    value, typed = literal(c.value, field.type), field.typed
    if value is None:
        return typed.isNull() if c.op in ("=", ">=", "<=") else typed.isNotNull() if c.op == "!=" else F.lit(False)
    right = lit(value, field.type)
    if c.op == "!=":
        found = typed.isNull() | (typed != right)
        return found | F.isnan(typed) if field.type.kind == "float" else found
    found = {"=": typed == right, ">": typed > right, ">=": typed >= right, "<": typed < right, "<=": typed <= right}[c.op]
    if c.op == "=" and field.type.kind == "float":
        found = found & ~F.isnan(typed)
    return typed.isNotNull() & found


def compile_filters(bound: Bound, conditions: Sequence[str] = (), expressions: Sequence[str] = (), row_number: Column | None = None) -> list[Column]:
    """All predicates, to be joined by AND; conditions first."""
    out = [compile_condition(parse_condition(c), bound) for c in conditions]
    if expressions:
        names = bound.names(row_number)
        out += [truthy(compile_expression(e, names)) for e in expressions]
    return out


def uses_row_number(expressions: Sequence[str]) -> bool:
    return any(re.search(r"\brow_number\b", e) for e in expressions)
