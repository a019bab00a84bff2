"""The ten logical column types and the Spark types that carry them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from quillframe.errors import UserError

MAX_PRECISION = 28
CURRENCY_SCALES = (2, 4)
ALIASES = {
    "string": "string", "integer": "integer", "int": "integer", "float": "float", "double": "float",
    "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "datetime", "date-time": "datetime",
    "timestamp": "datetime", "time": "time", "guid": "guid", "uuid": "guid", "currency": "currency",
}
TITLES = {"string": "String", "integer": "Integer", "float": "Float", "boolean": "Boolean", "date": "Date", "datetime": "DateTime", "time": "Time", "guid": "Guid", "currency": "Currency"}
SPARK = {
    "string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "datetime": T.TimestampNTZType(), "time": T.IntegerType(), "guid": T.StringType(), "currency": T.DecimalType(MAX_PRECISION, 4),
}
NUMERIC = ("integer", "float", "currency", "decimal")
TEMPORAL = ("date", "datetime", "time")


@dataclass(frozen=True)
class ColumnType:
    """A logical type: ``kind``, and precision and scale for ``decimal``."""

    kind: str
    precision: int = 0
    scale: int = 0

    def __post_init__(self):
        if self.kind == "decimal":
            if not 1 <= self.precision <= MAX_PRECISION:
                raise UserError(f"decimal precision must be between 1 and {MAX_PRECISION}, found {self.precision}")
            if not 0 <= self.scale <= self.precision:
                raise UserError(f"decimal scale {self.scale} must not exceed precision {self.precision}")
        elif self.kind not in SPARK:
            raise UserError(f"unknown column type {self.kind!r}")

    @staticmethod
    def parse(spec) -> "ColumnType":
        """From a name or alias, ``decimal(p,s)``, or ``{'decimal': {'precision': p, 'scale': s}}``."""
        if isinstance(spec, ColumnType):
            return spec
        if isinstance(spec, dict):
            body = spec.get("decimal", spec.get("Decimal"))
            if len(spec) != 1 or not isinstance(body, dict) or not {"precision", "scale"} <= body.keys():
                raise UserError(f"unknown column type {spec!r}")
            return ColumnType("decimal", int(body["precision"]), int(body["scale"]))
        text = str(spec).strip().lower()
        if text in ALIASES:
            return ColumnType(ALIASES[text])
        if m := re.fullmatch(r"decimal\s*\((.*)\)", text):
            found: dict[str, int] = {}
            for name, part in zip(("precision", "scale"), (parts := m[1].split(","))):
                key, _, value = part.rpartition("=")
                if not value.strip().isdigit() or key.strip() not in ("", "precision", "scale"):
                    raise UserError(f"bad decimal type {spec!r}")
                found[key.strip() or name] = int(value)
            if len(parts) == 2 and found.keys() == {"precision", "scale"}:
                return ColumnType("decimal", found["precision"], found["scale"])
        raise UserError(f"unknown column type {spec!r}")

    @staticmethod
    def of_spark(kind: T.DataType) -> "ColumnType":
        """The logical type that carries a Spark column; nested types count as text."""
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return INTEGER
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return FLOAT
        if isinstance(kind, T.BooleanType):
            return BOOLEAN
        if isinstance(kind, T.DateType):
            return DATE
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return DATETIME
        if isinstance(kind, T.DecimalType):
            return ColumnType("decimal", min(kind.precision, MAX_PRECISION), min(kind.scale, MAX_PRECISION))
        return STRING

    @property
    def spark(self) -> T.DataType:
        return T.DecimalType(self.precision, self.scale) if self.kind == "decimal" else SPARK[self.kind]

    def __str__(self) -> str:
        return f"decimal({self.precision},{self.scale})" if self.kind == "decimal" else self.kind

    def to_yaml(self):
        return {"decimal": {"precision": self.precision, "scale": self.scale}} if self.kind == "decimal" else TITLES[self.kind]


STRING, INTEGER, FLOAT, BOOLEAN = (ColumnType(k) for k in ("string", "integer", "float", "boolean"))
DATE, DATETIME, TIME, GUID, CURRENCY = (ColumnType(k) for k in ("date", "datetime", "time", "guid", "currency"))
