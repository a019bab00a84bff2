"""Cells: text to typed Columns, typed Columns to text, and driver-side literals.

Every parser gives NULL for empty text and for text the type does not admit;
``is_valid`` tells the two apart. Text is matched against an anchored pattern
before any cast, because Spark's casts trim and accept more.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.errors import UserError
from quillframe.functions.clock import clock_text, read_clock, seconds_text
from quillframe.types import ColumnType

# Accepted spellings and formats, in the order they are tried.
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y")
DATETIME_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M")
TIME_FORMATS = ("%H:%M:%S", "%H:%M")
CURRENCY_SIGNS = "$€£¥"

INT = r"^[+-]?[0-9]+$"
REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
GUID = r"^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32})$"


def filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def sanitized(text: Column, currency: bool) -> Column:
    """A plain signed number as text, or NULL: parentheses negate, grouping is dropped."""
    t = F.trim(text)
    wrapped = t.startswith("(") & t.endswith(")") & (F.length(t) >= 2)
    body = F.trim(F.when(wrapped, F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t))
    if currency:
        body = F.translate(body, CURRENCY_SIGNS, "")
    body = F.translate(body, ",_ ", "")
    negative = wrapped | body.startswith("-")
    digits = F.regexp_replace(body, r"^[+-]", "")
    ok = digits.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")
    plain = t.rlike(r"^-?[0-9]+\.?[0-9]*$")  # most cells, and already what is wanted
    return F.when(plain, t).otherwise(F.when(ok, F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits)))


def scale_of(number: Column) -> Column:
    """Digits after the point of a sanitized number."""
    return F.length(F.regexp_extract(number, r"\.([0-9]*)$", 1))


def _exact(number: Column, precision: int, scale: int) -> Column:
    whole = F.length(F.regexp_replace(F.regexp_extract(number, r"^-?([0-9]*)", 1), "^0+", ""))
    return F.when((scale_of(number) <= scale) & (whole <= precision - scale), F.regexp_replace(number, r"\.$", "").try_cast(f"decimal({precision},{scale})"))


def _pattern_date(text: Column, order: str, sep: str) -> Column:
    """A date by its component order; the parts are checked by try_to_date's strict calendar."""
    return F.try_to_timestamp(text, F.lit(sep.join({"y": "yyyy", "m": "M", "d": "d"}[c] for c in order)))


def parse_date(text: Column) -> Column:
    iso = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
    slash = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
    ymd = r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"
    dmy = r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"
    stamp = (
        F.when(text.rlike(iso), _pattern_date(text, "ymd", "-"))
        .when(text.rlike(slash), F.coalesce(_pattern_date(text, "dmy", "/"), _pattern_date(text, "mdy", "/")))
        .when(text.rlike(ymd), _pattern_date(text, "ymd", "/"))
        .when(text.rlike(dmy), _pattern_date(text, "dmy", "-"))
    )
    return stamp.cast("timestamp_ntz").cast("date")


def parse_datetime(text: Column) -> Column:
    t = F.regexp_replace(text, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})T", "$1 ")
    long = lambda p: read_clock(t, p)
    return (
        F.when(t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"), long("yyyy-M-d H:m:s"))
        .when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"), F.coalesce(long("d/M/yyyy H:m:s"), long("M/d/yyyy H:m:s")))
        .when(t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}$"), long("yyyy-M-d H:m"))
    )


def parse_time(text: Column) -> Column:
    """Seconds since midnight."""
    shape = r"^([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?$"
    part = lambda i: F.coalesce(filled(F.regexp_extract(text, shape, i)), F.lit("0")).cast("int")
    h, m, s = part(1), part(2), part(3)
    return F.when(text.rlike(shape) & (h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def parse_guid(text: Column) -> Column:
    t = F.lower(F.regexp_replace(F.trim(text), r"^\{+|\}+$", ""))
    t = F.regexp_replace(t, "^urn:uuid:", "")
    bare = F.replace(t, F.lit("-"), F.lit(""))
    parts = [F.substr(bare, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(t.rlike(GUID), F.concat_ws("-", *parts))


def parse_cell(text: Column, kind: ColumnType) -> Column:
    """The typed value of a cell; NULL when empty or not admitted."""
    t = filled(text)
    k = kind.kind
    if k == "string":
        return t
    if k == "integer":
        return F.when(t.rlike(INT), t.try_cast("bigint"))
    if k == "float":
        low = F.lower(t)
        special = F.when(low.rlike(r"^[+]?(inf|infinity)$"), float("inf")).when(low.rlike(r"^-(inf|infinity)$"), float("-inf")).when(low.rlike(r"^[+-]?nan$"), float("nan"))
        return F.when(t.rlike(REAL), t.try_cast("double")).otherwise(special)
    if k == "boolean":
        low = F.lower(t)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    if k == "date":
        return parse_date(t)
    if k == "datetime":
        return parse_datetime(t)
    if k == "time":
        return parse_time(t)
    if k == "guid":
        return parse_guid(t)
    number = sanitized(t, currency=k == "currency")
    if k == "currency":
        return F.when(scale_of(number).isin(0, 2, 4), F.regexp_replace(number, r"\.$", "").try_cast("decimal(28,4)"))
    return _exact(number, kind.precision, kind.scale)


def is_valid(text: Column, kind: ColumnType) -> Column:
    """Empty and NULL cells are valid in every type."""
    return text.isNull() | (text == "") | parse_cell(text, kind).isNotNull()


def float_text(value: Column) -> Column:
    """Shortest text without exponent; whole values without fraction."""
    plain = value.cast("string")
    wide = F.regexp_replace(F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e18)
    return (
        F.when(F.isnan(value), "NaN").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
        .when(whole, F.when(F.abs(value) < 1e18, value.try_cast("bigint")).cast("string"))
        .when(plain.contains("E"), F.coalesce(wide, plain))
        .otherwise(plain)
    )


def render_cell(value: Column, kind: ColumnType, scale: Column | None = None) -> Column:
    """Canonical text of a typed value; ``scale`` is a currency value's own scale (2 or 4)."""
    k = kind.kind
    if k == "float":
        return float_text(value)
    if k == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if k == "datetime":
        return clock_text(value)
    if k == "time":
        return seconds_text(value)
    if k == "currency":
        four = value.cast("decimal(28,4)").cast("string")
        two = value.cast("decimal(28,2)").cast("string")
        fine = (value != value.cast("decimal(28,2)")) if scale is None else (scale == 4)
        return F.when(fine, four).otherwise(two)
    return value.cast("string")


def literal(text: str, kind: ColumnType):
    """A driver-side value for the right-hand side of a comparison; None for empty text."""
    if text == "":
        return None
    k = kind.kind
    try:
        if k == "string":
            return text
        if k == "integer":
            if not re.fullmatch(INT, text) or not -(2**63) <= int(text) < 2**63:
                raise ValueError
            return int(text)
        if k == "float":
            if not re.fullmatch(REAL, text) and text.lower().lstrip("+-") not in ("inf", "infinity", "nan"):
                raise ValueError
            return float(text)
        if k == "boolean":
            return {**dict.fromkeys(TRUE, True), **dict.fromkeys(FALSE, False)}[text.lower()]
        if k == "guid":
            return str(uuid.UUID(text.strip().strip("{}")))
        if k in ("currency", "decimal"):
            return _literal_number(text, kind)
        formats = {"date": DATE_FORMATS, "datetime": DATETIME_FORMATS, "time": TIME_FORMATS}[k]
        for f in formats:
            try:
                found = dt.datetime.strptime(text, f)
            except ValueError:
                continue
            if k == "date":
                return found.date()
            return found if k == "datetime" else found.hour * 3600 + found.minute * 60 + found.second
        raise ValueError
    except (ValueError, KeyError) as e:
        raise UserError(f"cannot read {text!r} as {kind}") from e


def _literal_number(text: str, kind: ColumnType) -> Decimal:
    body, negative = text.strip(), False
    if body.startswith("(") and body.endswith(")"):
        body, negative = body[1:-1].strip(), True
    signs = CURRENCY_SIGNS if kind.kind == "currency" else ""
    body = "".join(c for c in body if c not in ",_ " + signs)
    negative |= body.startswith("-")
    body = body[1:] if body[:1] in ("+", "-") else body
    if not re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", body):
        raise ValueError
    value = Decimal(("-" if negative else "") + body)
    scale = -value.as_tuple().exponent
    if kind.kind == "currency" and scale not in (0, 2, 4):
        raise ValueError
    if kind.kind == "decimal" and (scale > kind.scale or abs(value) >= Decimal(10) ** (kind.precision - kind.scale)):
        raise ValueError
    return value


def lit(value, kind: ColumnType) -> Column:
    """A literal Column of the type's Spark type."""
    if kind.kind == "datetime":
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value).cast(kind.spark)
