"""Cell-level verification against a schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.errors import UserError
from quillframe.functions.cells import is_valid
from quillframe.functions.mappings import mapped, replaced_text
from quillframe.operators.binding import ORDINAL, STAGED, quoted, with_ordinal
from quillframe.schema import Schema


@dataclass(frozen=True)
class Report:
    """Which tiers a verification reports: nothing, a summary, details up to a limit."""

    detail: bool = False
    summary: bool = False
    limit: int | None = None

    @staticmethod
    def parse(tokens: Sequence[str] | None) -> "Report":
        """None: fail at the first bad cell. No token: summary. A lone number implies detail."""
        if tokens is None:
            return Report()
        detail = summary = False
        limit = None
        for t in (x.strip().lower() for token in tokens for x in token.split(":")):
            if t == "detail":
                detail = True
            elif t == "summary":
                summary = True
            elif t.isdigit():
                limit = int(t)
            elif t:
                raise UserError(f"unknown report option {t!r}; use detail, summary or a number")
        if limit is not None and not summary:
            detail = True
        return Report(detail, summary or not detail, limit)


def violations(df: DataFrame, schema: Schema, with_rows: bool = True) -> DataFrame:
    """One row a bad cell: row, position, column, raw, normalized, datatype, reason.

    ``row`` is the physical record number: the first data row is 2 below a
    header and 1 without. A cell whose mapping fails is reported too. Empty
    cells are valid. ``df`` has text columns in schema order.
    """
    schema.check_headers([c for c in df.columns if c != ORDINAL])
    first = 2 if schema.has_headers else 1
    if with_rows:
        df = with_ordinal(df, first)
    cells = []
    for i, (name, c) in enumerate(zip([c for c in df.columns if c != ORDINAL], schema.columns)):
        raw = F.coalesce(quoted(name).cast("string"), F.lit(""))
        df, carried = mapped(df, raw, c, f"{STAGED}{i}")
        text = replaced_text(carried, c)
        fine = carried.isNotNull() & is_valid(text, c.type)
        if c.type.kind == "string" and not c.mappings:
            continue
        reason = F.when(carried.isNull(), F.lit("datatype mapping failed")).otherwise(F.lit(f"cannot be read as {c.type}"))
        cell = F.struct(F.lit(i).alias("position"), F.lit(c.output).alias("column"), raw.alias("raw"), text.alias("normalized"), F.lit(str(c.type)).alias("datatype"), reason.alias("reason"))
        cells.append(F.when(~fine, cell))
    row = F.col(ORDINAL) if with_rows else F.lit(None).cast("bigint")
    if not cells:
        empty = "position int, column string, raw string, normalized string, datatype string, reason string"
        return df.sparkSession.createDataFrame([], f"row bigint, {empty}")
    return df.select(row.alias("row"), F.explode(F.array_compact(F.array(*cells))).alias("v")).select("row", "v.*")


def summary(found: DataFrame) -> DataFrame:
    """column, errors: sorted by column."""
    return found.groupBy("column").agg(F.count(F.lit(1)).alias("errors")).orderBy("column")


def details(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Bad cells in file order, at most ``limit``."""
    ordered = found.orderBy("row", "position")
    return ordered.limit(limit) if limit is not None else ordered


def first_violation(df: DataFrame, schema: Schema):
    """The first bad cell in file order, or None."""
    return details(violations(df, schema), 1).first()


def assert_valid(df: DataFrame, schema: Schema) -> None:
    bad = first_violation(df, schema)
    if bad:
        raise UserError(f"row {bad.row}, column {bad.column!r}: {bad.raw!r} {bad.reason}")
