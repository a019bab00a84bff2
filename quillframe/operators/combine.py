"""Append (union all) and equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.errors import UserError
from quillframe.functions.cells import render_cell
from quillframe.operators.binding import Field, bind, quoted
from quillframe.operators.transform import listed
from quillframe.schema import Schema
from quillframe.types import ColumnType

JOINS = ("inner", "left", "right", "full")


def append(frames: Sequence[DataFrame], schema: Schema | None = None, strict: bool = True) -> DataFrame:
    """All rows of all frames, by position, under one header.

    Without a schema every header must equal the first. With one, cells are
    mapped, replaced and validated (``strict``), and columns carry their output
    names.
    """
    if not frames:
        raise UserError("append needs at least one input")
    if schema is None:
        first = frames[0].columns
        for i, f in enumerate(frames[1:], 2):
            if f.columns != first:
                raise UserError(f"header of input {i} differs from the first: {f.columns} and {first}")
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out
    out = None
    for f in frames:
        bound = bind(f, schema)
        rows = (bound.checked() if strict else bound.df).select(*[x.text.alias(x.output) for x in bound.fields])
        out = rows if out is None else out.union(rows)
    return out


def _key(field: Field, other: ColumnType) -> Column:
    """What two keys are compared by: values, but the shown text of currencies."""
    if field.type.kind == "currency":
        return render_cell(field.typed, field.type, field.scale)
    if {field.type.kind, other.kind} == {"integer", "float"}:
        return field.typed.cast("double")
    return field.typed


def check_keys(left: Field, right: Field) -> None:
    a, b = left.type, right.type
    if a != b and {a.kind, b.kind} != {"integer", "float"}:
        raise UserError(f"join keys {left.name!r} ({a}) and {right.name!r} ({b}) have different types")


def join(left: DataFrame, right: DataFrame, left_key: str | Sequence[str], right_key: str | Sequence[str], how: str = "inner", left_schema: Schema | None = None, right_schema: Schema | None = None) -> DataFrame:
    """Equi-join on one or more keys; empty keys match empty keys.

    Columns: the left's, then the right's without its keys; a right name that
    is taken becomes ``right_<name>_<n>``. Rows of the right alone carry their
    key values in the left's key columns. Spark chooses the join strategy.
    """
    if how not in JOINS:
        raise UserError(f"unknown join type {how!r}; use one of {', '.join(JOINS)}")
    a, b = (listed([k] if isinstance(k, str) else k) for k in (left_key, right_key))
    if not a or len(a) != len(b):
        raise UserError("both sides need the same number of join keys")
    x, y = bind(left, left_schema), bind(right, right_schema)
    pairs = [(x.field(p), y.field(q)) for p, q in zip(a, b)]
    for p, q in pairs:
        check_keys(p, q)
    ls = left.select(*[_emitted(left, f).alias(f"l{i}") for i, f in enumerate(x.fields)], *[_key(p, q.type).alias(f"lk{i}") for i, (p, q) in enumerate(pairs)], F.lit(True).alias("l"))
    rs = right.select(*[_emitted(right, f).alias(f"r{i}") for i, f in enumerate(y.fields)], *[_key(q, p.type).alias(f"rk{i}") for i, (p, q) in enumerate(pairs)])
    condition = [F.col(f"lk{i}").eqNullSafe(F.col(f"rk{i}")) for i in range(len(pairs))]
    joined = ls.join(rs, condition, {"full": "full_outer"}.get(how, how))
    keys = {x.fields.index(p): y.fields.index(q) for p, q in pairs}
    out, names = [], []
    for i, f in enumerate(x.fields):
        filled = F.when(F.col("l"), F.col(f"l{i}")).otherwise(F.col(f"r{keys[i]}")) if i in keys and how in ("right", "full") else F.col(f"l{i}")
        out.append(filled.alias(f.name))
        names.append(f.name)
    for j, f in enumerate(y.fields):
        if j in keys.values():
            continue
        name = f.name if f.name not in names else free_name(f.name, names)
        names.append(name)
        out.append(F.col(f"r{j}").alias(name))
    return joined.select(*out)


def _emitted(df: DataFrame, f: Field) -> Column:
    """Text columns as mapped and replaced, typed ones as they are."""
    return f.text if dict(df.dtypes)[f.name] == "string" else quoted(f.name)


def free_name(name: str, taken: Sequence[str]) -> str:
    n = 1
    while (made := f"right_{name}_{n}") in taken:
        n += 1
    return made
