"""The expression language: text to a typed Column.

Grammar, loosest first: ``||``, ``&&``, comparisons, ``+ -``, ``* / %``,
unary ``- !``, ``^``, and primaries (numbers, "text", names, calls,
parentheses, tuples). Types are known before a row is read: int, float, bool,
str. Columns are bound by normalised header name and by position (c0, c1, ..);
dates, times and guids are text, decimals and currencies floats. A NULL cell
makes an arithmetic result NULL; in text it counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.errors import UserError
from quillframe.functions.cells import float_text, parse_date, parse_datetime, parse_time
from quillframe.functions.clock import clock_text, seconds_text, whole_seconds, write_clock
from quillframe.functions.strftime import spark_pattern

TOKENS = re.compile(
    r"""\s*(?:(?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>0x[0-9a-fA-F]+|\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)*)|(?P<op>\|\||&&|==|!=|<=|>=|[-+*/%^<>!(),]))"""
)
POWER = {"||": 10, "&&": 20, "==": 30, "!=": 30, "<": 30, "<=": 30, ">": 30, ">=": 30, "+": 40, "-": 40, "*": 50, "/": 50, "%": 50, "^": 70}
UNARY = 60


@dataclass(frozen=True)
class Value:
    """A compiled expression: its Column, its type, the members of a tuple, or the literal it is.

    Dates and times are text to the language; ``native`` keeps (kind, Column) of
    the value behind such text, so that it is not parsed again.
    """

    column: Column | None
    kind: str
    members: tuple = ()
    constant: object = None
    native: tuple | None = None


def normalize_name(name: str, fallback: str = "column") -> str:
    """Lower-case, every character but ASCII letters and digits to ``_``, no leading digit."""
    out = re.sub(r"[^A-Za-z0-9]", "_", name).lower()
    return (f"_{out}" if out[:1].isdigit() else out) or fallback


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKENS.match(text, at)
        if not m or m.end() == at:
            raise UserError(f"cannot read expression at {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def text_of(v: Value) -> Column:
    if v.kind == "str":
        return F.coalesce(v.column, F.lit(""))
    if v.kind == "float":
        return F.coalesce(float_text(v.column), F.lit(""))
    if v.kind == "tuple":
        return F.concat_ws("|", *map(text_of, v.members))
    return F.coalesce(v.column.cast("string"), F.lit(""))


def truthy(v: Value) -> Column:
    if v.kind == "bool":
        return F.coalesce(v.column, F.lit(False))
    if v.kind == "str":
        return F.coalesce(v.column != "", F.lit(False))
    if v.kind == "tuple":
        return F.lit(len(v.members) > 0) if not v.members else _any([truthy(m) for m in v.members])
    return F.coalesce(v.column != 0, F.lit(False))


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _temporal(reader: Callable[[Column], Column], what: str):
    """Reads a temporal argument; NULL and empty text give NULL, other text must parse."""

    def read(v: Value) -> Column:
        if v.kind != "str":
            raise UserError(f"expected {what} text, found {v.kind}")
        if v.native and v.native[0] == what:
            return v.native[1]
        text = F.nullif(v.column, F.lit(""))
        return F.coalesce(reader(text), F.when(text.isNotNull(), F.raise_error(F.lit(f"cannot read {what}"))))

    return read


DATE, DATETIME, TIME = _temporal(parse_date, "date"), _temporal(parse_datetime, "datetime"), _temporal(parse_time, "time")


def _dated(c: Column) -> Value:
    return Value(F.date_format(c, "yyyy-MM-dd"), "str", native=("date", c))


def _stamped(c: Column) -> Value:
    return Value(clock_text(c), "str", native=("datetime", c))


def _timed(c: Column) -> Value:
    return Value(seconds_text(c), "str", native=("time", c))


def _count(v: Value) -> Column:
    if v.kind == "int":
        return v.column
    if v.kind == "float":
        return F.when(v.column < 0, F.ceil(v.column)).otherwise(F.floor(v.column)).cast("bigint")
    raise UserError(f"expected a number, found {v.kind}")


def _number(v: Value) -> Column:
    if v.kind not in ("int", "float"):
        raise UserError(f"expected a number, found {v.kind}")
    return v.column


def _format(v: Value) -> str:
    if not isinstance(v.constant, str):
        raise UserError("a format must be a text literal")
    return v.constant


def _pattern(v: Value) -> str:
    return spark_pattern(_format(v))


def _time_add(t: Value, n: Value) -> Value:
    moved = TIME(t) + _count(n)
    return _timed(F.when(moved.between(0, 86399), moved).when(moved.isNotNull(), F.raise_error(F.lit("time_add_seconds crosses midnight"))))


def _seconds(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def _if(cond: Value, a: Value, b: Value) -> Value:
    if a.kind != b.kind and {a.kind, b.kind} != {"int", "float"}:
        return Value(F.when(truthy(cond), text_of(a)).otherwise(text_of(b)), "str")
    kind = a.kind if a.kind == b.kind else "float"
    return Value(F.when(truthy(cond), _as(a, kind)).otherwise(_as(b, kind)), kind)


def _as(v: Value, kind: str) -> Column:
    return v.column.cast("double") if kind == "float" and v.kind == "int" else v.column


def _extreme(pick: Callable):
    def build(*args: Value) -> Value:
        kind = "float" if any(a.kind == "float" for a in args) else "int"
        cols = [_as(Value(_number(a), a.kind), kind) for a in args]
        return Value(pick(*cols) if len(cols) > 1 else cols[0], kind)

    return build


def _math(f: Callable, kind: str = "float"):
    return lambda v: Value(f(_number(v).cast("double")).cast("double"), kind)


def _bits(f: Callable):
    return lambda a, b: Value(f(_count(a), _count(b)), "int")


def _substring(s: Value, start: Value, end: Value | None = None) -> Value:
    n = F.length(text_of(s)) if end is None else _count(end)
    return Value(F.substr(text_of(s), (_count(start) + 1).cast("int"), F.greatest(n - _count(start), F.lit(0)).cast("int")), "str")


def _contains(haystack: Value, *needles: Value) -> Value:
    members = haystack.members if haystack.kind == "tuple" else None
    wanted = [m for n in needles for m in (n.members if n.kind == "tuple" else (n,))]
    if members is not None:
        return Value(_any([compare("==", m, n).column for m in members for n in wanted if m.kind == n.kind] or [F.lit(False)]), "bool")
    return Value(_any([text_of(haystack).contains(text_of(n)) for n in wanted]), "bool")


#: name: (least arguments, most arguments, builder)
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Value]]] = {
    "concat": (0, 999, lambda *a: Value(F.concat(F.lit(""), *map(text_of, a)), "str")),
    "if": (3, 3, _if),
    "date_add": (2, 2, lambda d, n: _dated(F.date_add(DATE(d), _count(n).cast("int")))),
    "date_sub": (2, 2, lambda d, n: _dated(F.date_sub(DATE(d), _count(n).cast("int")))),
    "date_diff_days": (2, 2, lambda a, b: Value(F.datediff(DATE(a), DATE(b)).cast("bigint"), "int")),
    "date_format": (2, 2, lambda d, f: Value(F.date_format(DATE(d), _pattern(f)), "str")),
    "datetime_add_seconds": (2, 2, lambda t, n: _stamped(F.timestamp_add("SECOND", _count(n), DATETIME(t)))),
    "datetime_diff_seconds": (2, 2, lambda a, b: Value(F.timestamp_diff("SECOND", whole_seconds(DATETIME(b)), whole_seconds(DATETIME(a))), "int")),
    "datetime_to_date": (1, 1, lambda t: _dated(DATETIME(t).cast("date"))),
    "datetime_to_time": (1, 1, lambda t: _timed(_seconds(DATETIME(t)))),
    "datetime_format": (2, 2, lambda t, f: Value(write_clock(DATETIME(t), _format(f)), "str")),
    "time_add_seconds": (2, 2, lambda t, n: _time_add(t, n)),
    "time_diff_seconds": (2, 2, lambda a, b: Value((TIME(a) - TIME(b)).cast("bigint"), "int")),
    "min": (1, 99, _extreme(F.least)),
    "max": (1, 99, _extreme(F.greatest)),
    "len": (1, 1, lambda s: Value(F.lit(len(s.members)) if s.kind == "tuple" else F.octet_length(text_of(s)).cast("bigint"), "int")),
    "floor": (1, 1, _math(F.floor)),
    "ceil": (1, 1, _math(F.ceil)),
    "round": (1, 1, _math(F.round)),
    "contains": (2, 2, _contains),
    "contains_any": (2, 2, _contains),
    "typeof": (1, 1, lambda v: Value(F.lit({"str": "string", "bool": "boolean"}.get(v.kind, v.kind)), "str")),
    "math::abs": (1, 1, lambda v: Value(F.abs(_number(v)), v.kind)),
    "math::is_nan": (1, 1, lambda v: Value(F.isnan(_number(v).cast("double")), "bool")),
    "math::pow": (2, 2, lambda a, b: Value(F.pow(_number(a).cast("double"), _number(b).cast("double")), "float")),
    "math::log": (2, 2, lambda a, b: Value(F.log(_number(a).cast("double")) / F.log(_number(b).cast("double")), "float")),
    "math::atan2": (2, 2, lambda a, b: Value(F.atan2(_number(a).cast("double"), _number(b).cast("double")), "float")),
    "math::hypot": (2, 2, lambda a, b: Value(F.hypot(_number(a).cast("double"), _number(b).cast("double")), "float")),
    **{f"math::{n}": (1, 1, _math(f)) for n, f in {
        "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "exp2": lambda c: F.pow(F.lit(2.0), c), "ln": F.log, "log2": F.log2, "log10": F.log10,
        "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
        "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh}.items()},
    "str::to_lowercase": (1, 1, lambda s: Value(F.lower(text_of(s)), "str")),
    "str::to_uppercase": (1, 1, lambda s: Value(F.upper(text_of(s)), "str")),
    "str::trim": (1, 1, lambda s: Value(F.trim(text_of(s)), "str")),
    "str::from": (1, 1, lambda s: Value(text_of(s), "str")),
    "str::substring": (2, 3, _substring),
    "bitand": (2, 2, _bits(lambda a, b: a.bitwiseAND(b))),
    "bitor": (2, 2, _bits(lambda a, b: a.bitwiseOR(b))),
    "bitxor": (2, 2, _bits(lambda a, b: a.bitwiseXOR(b))),
    "bitnot": (1, 1, lambda a: Value(F.bitwise_not(_count(a)), "int")),
    "shl": (2, 2, _bits(lambda a, b: F.call_function("shiftleft", a, b.cast("int")))),
    "shr": (2, 2, _bits(lambda a, b: F.call_function("shiftright", a, b.cast("int")))),
}


def compare(op: str, a: Value, b: Value) -> Value:
    if {a.kind, b.kind} <= {"int", "float"}:
        kind = "float" if a.kind != b.kind else a.kind
        x, y = _as(a, kind), _as(b, kind)
    elif a.kind == b.kind and a.kind in ("str", "bool"):
        x, y = (text_of(a), text_of(b)) if a.kind == "str" else (a.column, b.column)
    elif op in ("==", "!="):
        return Value(F.lit(op == "!="), "bool")  # values of different types differ
    else:
        raise UserError(f"cannot compare {a.kind} with {b.kind}")
    return Value({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+" and "str" in (a.kind, b.kind):
        if a.kind != b.kind:
            raise UserError(f"cannot add {a.kind} and {b.kind}; use concat")
        return Value(F.concat(text_of(a), text_of(b)), "str")
    _number(a), _number(b)
    if op == "^":
        return Value(F.pow(a.column.cast("double"), b.column.cast("double")), "float")
    kind = "int" if a.kind == b.kind == "int" else "float"
    x, y = _as(a, kind), _as(b, kind)
    if op == "/" and kind == "int":
        return Value(F.call_function("div", x, y), "int")
    return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}[op](), kind)


class Compiler:
    """A Pratt parser that builds Columns as it reads."""

    def __init__(self, text: str, names: Mapping[str, Value]):
        self.text, self.names = text, names
        self.tokens, self.at = tokenize(text), 0

    def fail(self, message: str):
        raise UserError(f"expression {self.text!r}: {message}")

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, op: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if op is not None and token != ("op", op):
            self.fail(f"expected {op!r}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def run(self) -> Value:
        if not self.tokens:
            self.fail("is empty")
        out = self.expression(0)
        if self.peek()[0] != "end":
            self.fail(f"unexpected {self.peek()[1]!r}")
        return out

    def expression(self, least: int) -> Value:
        left = self.prefix()
        while (token := self.peek())[0] == "op" and POWER.get(token[1], -1) > least:
            op = self.take()[1]
            right = self.expression(POWER[op])
            try:
                left = self.binary(op, left, right)
            except UserError as e:
                self.fail(str(e))
        return left

    def binary(self, op: str, a: Value, b: Value) -> Value:
        if op in ("&&", "||"):
            for v in (a, b):
                if v.kind != "bool":
                    raise UserError(f"{op} needs booleans, found {v.kind}")
            x, y = truthy(a), truthy(b)
            return Value(x & y if op == "&&" else x | y, "bool")
        return compare(op, a, b) if POWER[op] == 30 else arithmetic(op, a, b)

    def prefix(self) -> Value:
        kind, text = self.take()
        if kind == "int":
            n = int(text, 0) if text.startswith("0x") else int(text)
            return Value(F.lit(n).cast("bigint"), "int", constant=n)
        if kind == "float":
            return Value(F.lit(float(text)), "float", constant=float(text))
        if kind == "str":
            s = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])
            return Value(F.lit(s), "str", constant=s)
        if kind == "name":
            return self.name(text)
        if (kind, text) == ("op", "("):
            members = self.arguments()
            if len(members) == 1:
                return members[0]
            return Value(None, "tuple", tuple(members))
        if (kind, text) == ("op", "-"):
            v = self.expression(UNARY)
            return Value(-_number(v), v.kind, constant=-v.constant if isinstance(v.constant, (int, float)) else None)
        if (kind, text) == ("op", "!"):
            v = self.expression(UNARY)
            return Value(~truthy(v), "bool")
        self.fail(f"unexpected {text or 'end'!r}")

    def arguments(self) -> list[Value]:
        """After an opening parenthesis, up to the closing one."""
        out: list[Value] = []
        if self.peek() == ("op", ")"):
            self.take()
            return out
        while True:
            out.append(self.expression(0))
            if self.peek() == ("op", ")"):
                self.take()
                return out
            self.take(",")

    def name(self, text: str) -> Value:
        if self.peek() == ("op", "("):
            self.take()
            args = self.arguments()
            if text not in FUNCTIONS:
                self.fail(f"unknown function {text!r}")
            least, most, build = FUNCTIONS[text]
            if not least <= len(args) <= most:
                self.fail(f"{text} takes {least if least == most else f'{least} or more'} arguments, found {len(args)}")
            try:
                return build(*args)
            except UserError as e:
                self.fail(f"{text}: {e}")
        if text in ("true", "false"):
            return Value(F.lit(text == "true"), "bool", constant=text == "true")
        found = self.names.get(text)
        if found is None:
            self.fail(f"unknown column {text!r}")
        return found


def compile_expression(text: str, names: Mapping[str, Value]) -> Value:
    return Compiler(text, names).run()
