"""Schema-governed tabular data on Spark: typing, transforming, profiling and checking."""

from quillframe.schema import ColumnMeta, Mapping, Schema
from quillframe.types import ColumnType

__all__ = ["ColumnMeta", "ColumnType", "Mapping", "Schema"]
