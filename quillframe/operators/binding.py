"""A DataFrame bound to a schema: for every column its text and its typed value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillframe.errors import UserError
from quillframe.functions.cells import is_valid, parse_cell, render_cell, sanitized, scale_of
from quillframe.functions.expressions import Value, normalize_name
from quillframe.functions.mappings import mapped, replaced_text
from quillframe.schema import ColumnMeta, Schema
from quillframe.storage import PART, WITHIN, numbered, offset
from quillframe.types import ColumnType

ORDINAL = "__ordinal"
STAGED = "__text"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True, eq=False)
class Field:
    """``text`` is the cell as emitted; ``typed`` the value that filters, sorts and statistics use."""

    name: str
    output: str
    type: ColumnType
    text: Column
    typed: Column
    valid: Column
    scale: Column | None = None  # of currency values, as written

    @property
    def aliases(self) -> tuple[str, ...]:
        return (self.name, self.output)


@dataclass(frozen=True)
class Bound:
    """The frame and its fields in order."""

    df: DataFrame
    fields: tuple[Field, ...]

    def field(self, name: str) -> Field:
        """By header name, overlaid with output names."""
        for f in reversed(self.fields):
            if f.output == name:
                return f
        for f in self.fields:
            if f.name == name:
                return f
        raise UserError(f"unknown column {name!r}; known: {', '.join(f.output for f in self.fields)}")

    def names(self, row_number: Column | None = None) -> dict[str, Value]:
        """What expressions can use: normalised header names, positions, row_number."""
        out: dict[str, Value] = {}
        for i, f in enumerate(self.fields):
            out[normalize_name(f.name)] = out[f"c{i}"] = expression_value(f)
        if row_number is not None:
            out["row_number"] = Value(row_number.cast("bigint"), "int")
        return out

    def checked(self) -> DataFrame:
        """The frame with a filter that fails the job at the first cell its type does not admit."""
        bad = None
        for f in self.fields:
            if f.type.kind == "string" and f.valid is None:
                continue
            message = F.concat(F.lit(f"column {f.output!r}: cannot read '"), F.coalesce(f.text, F.lit("")), F.lit(f"' as {f.type}"))
            bad = F.when(~f.valid, F.raise_error(message).cast("boolean")) if bad is None else bad.when(~f.valid, F.raise_error(message).cast("boolean"))
        return self.df if bad is None else self.df.where(bad.otherwise(True))


def expression_value(f: Field) -> Value:
    k = f.type.kind
    if k == "integer":
        return Value(f.typed, "int")
    if k in ("float", "currency", "decimal"):
        return Value(f.typed.cast("double"), "float")
    if k == "boolean":
        return Value(f.typed, "bool")
    if k == "string":
        return Value(f.text, "str")
    return Value(render_cell(f.typed, f.type), "str", native=(k, f.typed) if k != "guid" else None)


def bind(df: DataFrame, schema: Schema | None = None, mappings: bool = True) -> Bound:
    """Bind ``df`` to ``schema``.

    Text columns go through the mapping chain, then replacement; typed values
    are read after a second replacement, as a cell may be rewritten once for
    output and once more for its value. Typed columns (Parquet and the like)
    are their own values and are rendered to text on demand. Without a schema
    text is String and typed columns keep the logical type of their Spark type.
    Every step of a chain is a column of its own (``__text<i>_..``), so that a
    cell goes through its chain once, whatever is read from it.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in df.columns if c != ORDINAL]
    if schema is not None:
        schema.check_headers(names)
        metas = schema.columns
    else:
        metas = [ColumnMeta(n, ColumnType.of_spark(kinds[n])) for n in names]
    fields = []
    for i, (name, meta) in enumerate(zip(names, metas)):
        source = quoted(name)
        if isinstance(kinds[name], StringType):
            raw = F.coalesce(source, F.lit(""))
            carried = raw
            if mappings and meta.mappings:
                df, carried = mapped(df, raw, meta, f"{STAGED}{i}")
            text = replaced_text(carried, meta)
            again = replaced_text(text, meta)
            scale = scale_of(sanitized(again, True)) if meta.type.kind == "currency" else None
            fields.append(Field(name, meta.output, meta.type, text, parse_cell(again, meta.type), carried.isNotNull() & is_valid(again, meta.type), scale))
        else:
            typed = source if ColumnType.of_spark(kinds[name]) == meta.type else source.cast(meta.type.spark)
            if meta.type.kind == "integer":
                typed = source.cast("bigint")
            shown = source.cast("string") if meta.type.kind == "string" else render_cell(typed, meta.type)
            fields.append(Field(name, meta.output, meta.type, F.coalesce(shown, F.lit("")), shown if meta.type.kind == "string" else typed, F.lit(True)))
    return Bound(df, tuple(fields))


def with_ordinal(df: DataFrame, start: int = 1) -> DataFrame:
    """``df`` with ``__ordinal``: the contiguous position of each row in input order.

    Rows of Parquet files are numbered by file, in the order of their paths, and
    row within it: the files' rows are counted in one pass and numbered in
    another, and no row moves. Other plans without shuffles and files give the
    same partitions every time, and are counted and numbered by these. The rows
    of any other plan are first written with their places. One offset a file or
    partition is joined by broadcast; a row without one fails the job.
    """
    if ORDINAL in df.columns:
        return df
    by_file = _by_file(df, start)
    if by_file is not None:
        return by_file
    if any(step in df._jdf.queryExecution().executedPlan().toString() for step in ("Exchange", "Limit", "Sample", "InMemory")):
        return numbered(df, ORDINAL, start)
    return offset(df.withColumns({PART: F.spark_partition_id(), WITHIN: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), ORDINAL, start)


def _by_file(df: DataFrame, start: int) -> DataFrame | None:
    """``with_ordinal`` of a projection of Parquet files, else None; how the scan is split may differ between the passes."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation" or "fileFormat" not in dir(plan.relation()) or plan.relation().fileFormat().toString() != "Parquet":
        return None
    if any(c.lower() == "_metadata" for c in df.columns):
        return None
    try:
        placed = df.withColumns({PART: F.col("_metadata.file_path"), WITHIN: F.col("_metadata.row_index")})
    except AnalysisException:  # a projection that hides where its rows come from
        return None
    found = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"), F.max(WITHIN).alias("last")).collect()
    if any(r["rows"] != r["last"] + 1 for r in found):  # a file that is read twice
        return None
    return offset(placed, ORDINAL, start, {r[PART]: r["rows"] for r in found})
