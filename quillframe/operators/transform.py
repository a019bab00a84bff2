"""The process verb: filter, derive, project, sort, limit, number."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.errors import UserError
from quillframe.functions.expressions import Value, compile_expression, text_of
from quillframe.operators.binding import ORDINAL, Bound, Field, bind, with_ordinal
from quillframe.operators.filters import compile_filters, uses_row_number
from quillframe.schema import Schema
from quillframe.storage import numbered

ROW_NUMBER = "row_number"
BOOLEAN_FORMATS = {"original": None, "true-false": ("true", "false"), "one-zero": ("1", "0")}


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True


def listed(tokens: Sequence[str]) -> list[str]:
    """Comma lists and repeats as one list."""
    return [t.strip() for token in tokens for t in token.split(",") if t.strip()]


def parse_sort(tokens: Sequence[str]) -> list[SortKey]:
    out = []
    for token in listed(tokens):
        name, _, direction = token.partition(":")
        if direction.strip().lower() not in ("", "asc", "desc") or not name.strip():
            raise UserError(f"bad sort directive {token!r}; use column[:asc|desc]")
        out.append(SortKey(name.strip(), direction.strip().lower() != "desc"))
    return out


def parse_derive(text: str) -> tuple[str, str]:
    name, found, expression = text.partition("=")
    if not found or not name.strip() or not expression.strip():
        raise UserError(f"bad derived column {text!r}; use name=expression")
    return name.strip(), expression.strip()


def sort_columns(bound: Bound, keys: Sequence[SortKey]) -> list[Column]:
    """NULL before every value: first when ascending, last when descending."""
    return [f.asc_nulls_first() if k.ascending else f.desc_nulls_last() for k in keys for f in (bound.field(k.column).typed,)]


def boolean_text(field: Field, style: str) -> Column:
    yes, no = BOOLEAN_FORMATS[style]
    return F.when(field.typed, yes).when(~field.typed, no).otherwise("")


def _shown(field: Field, style: str, text: bool) -> Column:
    if field.type.kind == "boolean" and style != "original":
        return boolean_text(field, style)
    return field.text if text else field.typed


def _derived(value: Value, text: bool) -> Column:
    return text_of(value) if text or value.kind == "tuple" else value.column


def process(
    df: DataFrame,
    schema: Schema | None = None,
    *,
    columns: Sequence[str] = (),
    exclude: Sequence[str] = (),
    derive: Sequence[str] = (),
    filters: Sequence[str] = (),
    filter_exprs: Sequence[str] = (),
    sort: Sequence[str] = (),
    limit: int | None = None,
    row_numbers: bool = False,
    boolean_format: str = "original",
    apply_mappings: bool = False,
    skip_mappings: bool = False,
    strict: bool = False,
    as_text: bool | None = None,
    stable: bool = True,
) -> DataFrame:
    """One declarative plan for all of the verb's options.

    ``as_text`` emits cells as text (the default when a schema is given), else
    typed columns. ``strict`` fails at the first cell that its type does not
    admit. ``stable`` breaks ties of the sort by input order, which needs the
    rows' ordinals; turn it off where the keys are unique.
    """
    if apply_mappings and skip_mappings:
        raise UserError("apply_mappings and skip_mappings exclude each other")
    if boolean_format not in BOOLEAN_FORMATS:
        raise UserError(f"unknown boolean format {boolean_format!r}")
    if limit is not None and limit < 0:
        raise UserError("limit must not be negative")
    keys, derived = parse_sort(sort), [parse_derive(d) for d in derive]
    as_text = schema is not None if as_text is None else as_text
    numbered_input = uses_row_number(filter_exprs)
    numbered_output = row_numbers or uses_row_number([e for _, e in derived])
    if numbered_input or (keys and stable):
        df = with_ordinal(df)
    bound = bind(df, schema, mappings=not skip_mappings)
    rows = bound.checked() if strict else bound.df
    for predicate in compile_filters(bound, filters, filter_exprs, F.col(ORDINAL) if numbered_input else None):
        rows = rows.where(predicate)
    order = sort_columns(bound, keys)
    if keys and stable:
        order.append(F.col(ORDINAL).asc())
    position = None
    if order:
        rows = rows.orderBy(*order)
    if limit is not None:
        rows = rows.limit(limit)
    if numbered_output:
        rows, position = number_rows(rows, order, limit)
    return rows.select(*output_columns(bound, columns, exclude, derived, position, row_numbers, boolean_format, as_text))


def number_rows(rows: DataFrame, order: list[Column], limit: int | None) -> tuple[DataFrame, Column]:
    """Output positions from 1.

    A limited result is numbered by a window, which Spark plans on top of its
    top-k. An unlimited one keeps its partitions: it is range-sorted once,
    written with its places, and numbered by partition offsets.
    """
    if limit is not None and order:
        rows = rows.withColumn("__position", F.row_number().over(Window.orderBy(*order)))
    else:
        rows = numbered(rows, "__position")
    return rows, F.col("__position").cast("bigint")


def output_columns(bound: Bound, columns, exclude, derived, position, row_numbers, boolean_format, as_text) -> list[Column]:
    """Row number, then existing columns in the order asked for, then derived ones."""
    wanted, gone = listed(columns), set(listed(exclude))
    fields = [bound.field(c) for c in wanted if c not in gone] if wanted else [f for f in bound.fields if not gone & set(f.aliases)]
    out = [position.cast("string").alias(ROW_NUMBER) if as_text else position.alias(ROW_NUMBER)] if row_numbers else []
    out += [_shown(f, boolean_format, as_text).alias(f.output) for f in fields]
    if derived:
        names = bound.names(position)
        out += [_derived(compile_expression(e, names), as_text).alias(n) for n, e in derived]
    if not out:
        raise UserError("no columns are left to output")
    return out
