"""Mapping chains: a cell's text carried through typed steps and back to text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.cells import float_text, parse_cell, render_cell, sanitized, scale_of
from quillframe.functions.clock import read_clock, seconds_text, write_clock
from quillframe.functions.strftime import spark_pattern
from quillframe.schema import ColumnMeta, Mapping
from quillframe.types import ColumnType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fixed(number: Column, scale: int, truncate: bool) -> Column:
    """An exact number at ``scale`` digits: half away from zero, or cut towards zero."""
    wide = number.cast("decimal(38,10)")
    if truncate:
        cut = F.when(wide < 0, F.ceil(wide, F.lit(scale))).otherwise(F.floor(wide, F.lit(scale)))
        return cut.cast(f"decimal(38,{scale})")
    return F.round(wide, scale).cast(f"decimal(38,{scale})")


@dataclass(frozen=True)
class Step:
    """A value on its way through a chain; ``scale`` is a currency's own number of digits (2 or 4)."""

    value: Column
    scale: Column | None = None


def _currency(number: Column, own: Column, wanted: int | None, truncate: bool) -> Step:
    """An exact number of ``own`` digits as a currency.

    It is cut to ``wanted`` digits (without: 4 where it has 4 or more, else 2),
    never filled up. What then has 1 or 3 digits is no currency; 0 count as 2.
    """
    goal = F.lit(wanted) if wanted else F.when(own >= 4, 4).otherwise(2)
    left = F.least(own, goal)
    two, four = (_fixed(number, s, truncate).cast("decimal(28,4)") for s in (2, 4))
    fine = left.isin(0, 2, 4)
    return Step(F.when(fine, F.when(goal == 4, four).otherwise(two)), F.when(fine, F.when(left == 4, 4).otherwise(2)))


def _to_number(of: Step, step: Mapping, kept=lambda value: value) -> Step:
    """Numeric targets; of a text, ``of`` has its number and its digits."""
    a, b, how = step.source.kind, step.target.kind, step.strategy
    value, own = of.value, of.scale
    if a == "float" and b in ("currency", "decimal"):
        plain = kept(float_text(value))  # by its text, so no binary noise
        value, own = plain.try_cast("decimal(38,10)"), scale_of(plain)
    elif a == "decimal":
        own = F.lit(step.source.scale)
    elif a == "integer":
        own = F.lit(0)
    if b == "integer":
        if a == "float":
            return Step((F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)) if how == "truncate" else F.round(value)).cast("bigint"))
        return Step(_fixed(value, 0, how == "truncate").cast("bigint"))
    if b == "float":
        number = value.cast("double")
        if a == "float" or how == "round":
            return Step(F.round(number, int(step.options.get("scale", 4))))
        return Step(number)
    if b == "currency":
        return _currency(value, F.coalesce(own, F.lit(0)), step.options.get("scale"), how == "truncate")
    p, s = step.target.precision, step.target.scale
    if how in ("round", "truncate"):
        number = _fixed(value, s, how == "truncate")
    else:
        number = F.when(value.cast("decimal(38,10)") == _fixed(value, s, True), _fixed(value, s, True))
    return Step(number.try_cast(f"decimal({p},{s})"))


def _read(text: Column, step: Mapping) -> Step:
    """Text to the step's target type."""
    b, form = step.target.kind, step.options.get("format")
    trimmed = F.trim(text)
    if b == "string":
        return Step({None: lambda: text, "trim": lambda: trimmed, "lowercase": lambda: F.translate(text, UPPER, LOWER), "uppercase": lambda: F.translate(text, LOWER, UPPER)}.get(step.strategy, lambda: text)())
    if b in ("date", "datetime", "time") and form:
        stamp = read_clock(trimmed, spark_pattern(form, reading=True))
        if b == "date":
            return Step(stamp.cast("date"))
        return Step(stamp if b == "datetime" else F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp))
    if b == "float":
        number = parse_cell(trimmed, step.target)
        return Step(F.round(number, int(step.options.get("scale", 4))) if step.strategy == "round" else number)
    return Step(parse_cell(trimmed, step.target))


def _write(of: Step, step: Mapping) -> Column:
    """A typed value to text."""
    a, form, value = step.source.kind, step.options.get("format"), of.value
    if a == "datetime" and form:
        return write_clock(value, form)
    if a == "date" and form:
        return F.date_format(value, spark_pattern(form))
    if a == "time" and form:
        return write_clock(F.timestamp_add("SECOND", value, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")), form)
    if a == "float":
        return F.format_string(f"%.{int(step.options.get('scale', 4))}f", value)
    return render_cell(value, step.source, of.scale)


def _convert(of: Step, step: Mapping, kept) -> Step:
    a, b = step.source.kind, step.target.kind
    if b == "string":
        return Step(_write(of, step))
    if a == "datetime":
        value = of.value
        return Step(value.cast("date") if b == "date" else F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value))
    return _to_number(of, step, kept)


def final_text(of: Step, last: Mapping) -> Column:
    """The text that a finished chain leaves in the cell."""
    k, value = last.target.kind, of.value
    if k == "string":
        return value
    if k == "float":
        return F.format_string(f"%.{int(last.options.get('scale', 4))}f", value)
    if k == "time":
        return seconds_text(value)
    return render_cell(value, last.target, of.scale)


def _parsed(text: Column, kind: ColumnType) -> Step:
    scale = scale_of(sanitized(text, True)) if kind.kind == "currency" else None
    return Step(parse_cell(text, kind), scale)


def mapped(df: DataFrame, raw: Column, column: ColumnMeta, name: str) -> tuple[DataFrame, Column]:
    """A cell's text after the column's chain; empty cells stay, failed cells become NULL.

    What a step reads or leaves is a column of its own, named after ``name``, so
    that no step is computed twice and no plan grows with the chain's length.
    """
    if not column.mappings:
        return df, raw

    def kept(value: Column, what: str) -> Column:
        nonlocal df
        df = df.withColumn(f"{name}_{what}", value)
        return F.col(f"{name}_{what}")

    of = None
    for k, step in enumerate(column.mappings):
        if step.source.kind == "string":
            text = raw if of is None else of.value
            if step.target.kind in ("currency", "decimal"):
                plain = kept(sanitized(F.trim(text), currency=step.target.kind == "currency"), f"plain{k}")
                number = kept(F.regexp_replace(plain, r"\.$", "").try_cast("decimal(38,10)"), f"number{k}")
                of = _to_number(Step(number, kept(scale_of(plain), f"own{k}")), step)
            else:
                of = _read(text, step)
        else:
            of = _convert(_parsed(F.trim(raw), step.source) if of is None else of, step, lambda v, k=k: kept(v, f"text{k}"))
        of = Step(kept(of.value, f"value{k}"), None if of.scale is None else kept(of.scale, f"scale{k}"))
    text = kept(F.when(raw == "", raw).otherwise(final_text(of, column.mappings[-1])), "text")
    return df, text


def replaced_text(text: Column, column: ColumnMeta) -> Column:
    """The first replacement whose left side is the whole cell."""
    out = None
    for old, new in column.replace:
        out = F.when(text == old, F.lit(new)) if out is None else out.when(text == old, F.lit(new))
    return text if out is None else out.otherwise(text)
