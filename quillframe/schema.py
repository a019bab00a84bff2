"""Declared schemas: columns, replacements, mapping chains, YAML files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from quillframe.errors import UserError
from quillframe.types import CURRENCY_SCALES, STRING, ColumnType

VERSION = "1.1.0"
CASES = ("trim", "lowercase", "uppercase")
ROUNDED = ("float", "integer", "string", "currency", "decimal")
TRUNCATED = ("integer", "currency", "decimal")


@dataclass(frozen=True)
class Mapping:
    """One step of a chain: from type, to type, strategy and options (format, scale)."""

    source: ColumnType
    target: ColumnType
    strategy: str | None = None
    options: dict = field(default_factory=dict, hash=False)

    def check(self, column: str) -> None:
        a, b = self.source.kind, self.target.kind
        where = f"column {column!r}: mapping {a} to {b}"
        if not allowed(a, b):
            raise UserError(f"{where} is not supported")
        s = self.strategy
        if s is not None and s not in ("round", "truncate", *CASES):
            raise UserError(f"{where}: unknown strategy {s!r}")
        if s in CASES and (a, b) != ("string", "string"):
            raise UserError(f"{where}: strategy {s!r} is for string to string")
        if s == "round" and b not in ROUNDED:
            raise UserError(f"{where}: strategy 'round' needs a numeric or string target")
        if s == "truncate" and b not in TRUNCATED:
            raise UserError(f"{where}: strategy 'truncate' needs an integer, currency or decimal target")
        if "precision" in self.options:
            raise UserError(f"{where}: option 'precision' is not allowed; declare decimal(p,s)")
        if "scale" in self.options:
            scale = self.options["scale"]
            if b == "decimal":
                raise UserError(f"{where}: option 'scale' is not allowed for decimal targets")
            if not isinstance(scale, int) or isinstance(scale, bool) or scale < 0:
                raise UserError(f"{where}: option 'scale' must be a non-negative integer")
            if b == "currency" and scale not in CURRENCY_SCALES:
                raise UserError(f"{where}: currency scale must be 2 or 4")
        if "format" in self.options and not isinstance(self.options["format"], str):
            raise UserError(f"{where}: option 'format' must be text")


def allowed(a: str, b: str) -> bool:
    """Whether a mapping step between two kinds exists."""
    numbers = ("integer", "float", "currency", "decimal")
    if a == "string" or b == "string":
        return True
    if a == "datetime":
        return b in ("date", "time")
    return a in numbers and b in numbers


@dataclass
class ColumnMeta:
    """A column: header name, type, output name, replacements, mapping chain."""

    name: str
    type: ColumnType = STRING
    rename: str | None = None
    replace: list[tuple[str, str]] = field(default_factory=list)
    mappings: list[Mapping] = field(default_factory=list)

    @property
    def output(self) -> str:
        return self.rename or self.name


@dataclass
class Schema:
    """Columns in file order; looked up by header name or output name."""

    columns: list[ColumnMeta]
    has_headers: bool = True
    version: str = VERSION

    def find(self, name: str) -> ColumnMeta | None:
        return next((c for c in self.columns if name in (c.name, c.rename)), None)

    def index_of(self, name: str) -> int:
        for i, c in enumerate(self.columns):
            if name in (c.name, c.rename):
                return i
        raise UserError(f"unknown column {name!r}")

    def check(self) -> "Schema":
        """Names are unique, chains connect and end in the column's type, options are legal."""
        seen: set[str] = set()
        for c in self.columns:
            for name in {c.name, c.output}:
                if name in seen:
                    raise UserError(f"duplicate column name {name!r}")
                seen.add(name)
            for step in c.mappings:
                step.check(c.name)
            for a, b in zip(c.mappings, c.mappings[1:]):
                if a.target != b.source:
                    raise UserError(f"column {c.name!r}: mapping chain breaks between {a.target} and {b.source}")
            if c.mappings and c.mappings[-1].target != c.type:
                raise UserError(f"column {c.name!r}: mapping chain ends in {c.mappings[-1].target}, not {c.type}")
        return self

    def check_headers(self, headers: Sequence[str]) -> None:
        """Every header is its column's name or output name, in order."""
        if not self.has_headers:
            return
        if len(headers) != len(self.columns):
            raise UserError(f"header has {len(headers)} columns, schema has {len(self.columns)}")
        for i, (h, c) in enumerate(zip(headers, self.columns), 1):
            if h not in (c.name, c.rename):
                raise UserError(f"header mismatch in column {i}: expected {c.name!r}, found {h!r}")

    def signature(self) -> str:
        return hashlib.sha256("".join(f"{c.name}:{c.type};" for c in self.columns).encode()).hexdigest()

    @staticmethod
    def load(path: str | Path) -> "Schema":
        return Schema.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})

    @staticmethod
    def from_dict(raw: dict) -> "Schema":
        """Unknown keys are tolerated; ``value_replacements`` is an alias of ``replace``."""
        columns = []
        for c in raw.get("columns") or []:
            swaps = c.get("replace", c.get("value_replacements")) or []
            steps = [
                Mapping(ColumnType.parse(m["from"]), ColumnType.parse(m["to"]), m.get("strategy"), dict(m.get("options") or {}))
                for m in c.get("datatype_mappings") or []
            ]
            pairs = [(str(s["from"]), str(s["to"])) for s in swaps]
            columns.append(ColumnMeta(str(c["name"]), ColumnType.parse(c["datatype"]), c.get("name_mapping") or None, pairs, steps))
        return Schema(columns, bool(raw.get("has_headers", True)), str(raw.get("schema_version") or VERSION)).check()

    def to_dict(self, replace_template: bool = False) -> dict:
        out = []
        for c in self.columns:
            item: dict = {"name": c.name, "datatype": c.type.to_yaml()}
            if c.rename:
                item["name_mapping"] = c.rename
            if c.replace or replace_template:
                item["replace"] = [{"from": a, "to": b} for a, b in c.replace]
            if c.mappings:
                item["datatype_mappings"] = [
                    {"from": m.source.to_yaml(), "to": m.target.to_yaml()} | ({"strategy": m.strategy} if m.strategy else {}) | ({"options": dict(m.options)} if m.options else {})
                    for m in c.mappings
                ]
            out.append(item)
        return {"schema_version": VERSION} | ({} if self.has_headers else {"has_headers": False}) | {"columns": out}

    def to_yaml(self, replace_template: bool = False) -> str:
        return yaml.safe_dump(self.to_dict(replace_template), sort_keys=False, allow_unicode=True)

    def save(self, path: str | Path, replace_template: bool = False) -> None:
        self.check()
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(self.to_yaml(replace_template), encoding="utf-8")

    def listing(self) -> list[tuple[str, str, str, str]]:
        """(#, name, type, output) of every column."""
        return [(str(i), c.name, str(c.type), c.output) for i, c in enumerate(self.columns, 1)]


def manual_schema(specs: Sequence[str], replacements: Sequence[str] = ()) -> Schema:
    """From ``name:type[->output]`` specs (comma lists or repeats) and ``column=a->b`` swaps."""
    columns: list[ColumnMeta] = []
    for token in (t.strip() for s in specs for t in s.split(",")):
        if not token:
            continue
        head, arrow, rename = token.partition("->")
        name, colon, kind = head.partition(":")
        if not name.strip() or not colon or (arrow and not rename.strip()):
            raise UserError(f"bad column definition {token!r}; use name:type or name:type->output")
        columns.append(ColumnMeta(name.strip(), ColumnType.parse(kind), rename.strip() or None))
    if not columns:
        raise UserError("at least one column is required")
    schema = Schema(columns).check()
    for spec in replacements:
        m = re.fullmatch(r"([^=]+)=(.*?)->(.*)", spec, re.S)
        column = schema.find(m[1].strip()) if m else None
        if not m or not column:
            raise UserError(f"bad replacement {spec!r}; use column=old->new with a known column")
        column.replace.append((m[2].strip(), m[3].strip()))
    return schema


def apply_overrides(schema: Schema, overrides: Sequence[str]) -> set[str]:
    """Set types from ``name:type`` by original name; gives the names that were set."""
    done: set[str] = set()
    for spec in overrides:
        name, colon, kind = spec.partition(":")
        column = next((c for c in schema.columns if c.name == name.strip()), None)
        if not colon or column is None:
            raise UserError(f"bad override {spec!r}; use name:type with an original column name")
        if column.name in done:
            raise UserError(f"duplicate override for {column.name!r}")
        column.type, column.mappings = ColumnType.parse(kind), []
        done.add(column.name)
    return done


def snake_case(name: str) -> str:
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]+", "_", words)).strip("_").lower()
