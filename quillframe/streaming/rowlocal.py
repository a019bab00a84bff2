"""The row-local part of ``process`` on a stream.

Mapping, replacement, typing, filters, derivation and projection look at one
row at a time, so they run on a streaming DataFrame as they do on a batch.
Sorting, limits, row numbers and medians need the whole input and do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quillframe.errors import UserError
from quillframe.operators.filters import uses_row_number
from quillframe.operators.transform import parse_derive, process
from quillframe.schema import Schema


def process_stream(df: DataFrame, schema: Schema | None = None, *, columns: Sequence[str] = (), exclude: Sequence[str] = (), derive: Sequence[str] = (), filters: Sequence[str] = (), filter_exprs: Sequence[str] = (), boolean_format: str = "original", skip_mappings: bool = False, strict: bool = False) -> DataFrame:
    """``process`` without the options that need the whole input."""
    if uses_row_number(filter_exprs) or uses_row_number([parse_derive(d)[1] for d in derive]):
        raise UserError("row_number is not defined on a stream")
    return process(df, schema, columns=columns, exclude=exclude, derive=derive, filters=filters, filter_exprs=filter_exprs, boolean_format=boolean_format, skip_mappings=skip_mappings, strict=strict)
