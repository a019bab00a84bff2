"""Schema discovery: header layout, type votes, placeholders, the probe report."""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.errors import UserError
from quillframe.functions.cells import DATE_FORMATS, DATETIME_FORMATS, TIME_FORMATS, literal, parse_date, parse_datetime, parse_guid, parse_time
from quillframe.operators.binding import quoted
from quillframe.plans.render import render_table
from quillframe.schema import ColumnMeta, Mapping, Schema, snake_case
from quillframe.types import BOOLEAN, CURRENCY, DATE, DATETIME, FLOAT, GUID, INTEGER, MAX_PRECISION, STRING, TIME, ColumnType

# Tokens, thresholds and sizes of the detection rules.
HEADER_WORDS = (
    "address", "amount", "category", "city", "code", "country", "created", "currency", "date", "description", "email", "first_name", "id", "item",
    "last_name", "name", "phone", "price", "quantity", "state", "status", "total", "type", "updated", "zip",
)
BOOLEAN_WORDS = ("true", "false", "t", "f", "yes", "no", "y", "n")
PLACEHOLDERS = ("na", "n/a", "n.a.", "null", "none", "unknown", "missing")
LAYOUT_ROWS = 6
SYMBOL_PERCENT = 30
HEADER_PERCENT, HEADER_LEAST = 80, 4
TRACKED = 5
UNDECODED = "__undecoded"


def synthetic_names(width: int) -> list[str]:
    return [f"field_{i}" for i in range(width)]


def _reads_as(value: str, kind: ColumnType) -> bool:
    try:
        literal(value, kind)
    except UserError:
        return False
    return True


def looks_like_data(value: str) -> bool:
    v = value.strip()
    if not v:
        return False
    kinds = (FLOAT, ColumnType("decimal", MAX_PRECISION, MAX_PRECISION // 2), CURRENCY, DATETIME, DATE, TIME, GUID)
    return v.lower() in (*BOOLEAN_WORDS, "1", "0") or any(_reads_as(v, k) for k in kinds)


def _is_header_word(value: str) -> bool:
    v = value.strip().lower()
    return v in HEADER_WORDS or re.sub(r"[ \-/]", "_", v) in HEADER_WORDS


def looks_like_header(value: str) -> bool:
    v = value.strip()
    return bool(v) and not looks_like_data(v) and (bool(re.search("[A-Za-z]", v)) or _is_header_word(v))


def has_header(rows: Sequence[Sequence[str]]) -> bool:
    """Whether the first of some leading rows is a header.

    Votes by column: a name above data speaks for a header, data above data
    against one; ties go to known header words, then to the first row's own look.
    """
    if not rows:
        return True
    first, rest = rows[0], rows[1:]
    names, data = sum(map(looks_like_header, first)), sum(map(looks_like_data, first))
    known = sum(_is_header_word(v) for v in first) >= 2
    if data > names or not names + data:
        return False
    if not rest:
        return names >= 2 or known
    balance = 0
    for i, v in enumerate(first):
        if any(len(r) > i and looks_like_data(r[i]) for r in rest):
            balance += 1 if looks_like_header(v) else -1 if looks_like_data(v) else 0
    if balance:
        return balance > 0
    return (known and names >= 1) or names > data


def header_aliases(name: str) -> set[str]:
    """Spellings under which a header may repeat inside the data."""
    base = name.strip()
    found = {base, *(base.rsplit(s, 1)[-1] for s in "_ /")}
    plain = "".join(c for c in base if c in "+-" or (c.isascii() and c.isalnum()))
    if plain:
        found |= {plain, *([plain[0] + plain[-1]] if len(plain) >= 2 else []), *([plain[:3]] if len(plain) >= 3 else []), *([plain[:4]] if len(plain) >= 4 else [])}
    return {f.strip().lower() for f in found if f.strip()}


def header_like_row(columns: Sequence[str]) -> Column:
    """True for rows that repeat the header: enough cells that spell their own column."""
    hits, full = F.lit(0), F.lit(0)
    for name in columns:
        cell = F.lower(F.trim(F.coalesce(quoted(name).cast("string"), F.lit(""))))
        full = full + (cell != "").cast("int")
        aliases = header_aliases(name)
        if aliases:
            hits = hits + cell.isin(*sorted(aliases)).cast("int")
    return (hits >= HEADER_LEAST) & (hits * 100 >= full * HEADER_PERCENT)


def is_placeholder(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(text)), "^#+", "")
    return (F.trim(text) != "") & (bare.isin(*PLACEHOLDERS) | bare.startswith("invalid") | bare.rlike("^-*$"))


SHAPE = r"^([+-]?)([0-9]*)(\.?)([0-9]*)(?:([eE])([+-]?[0-9]{1,9}))?$"


def numeric_tokens(rows: DataFrame) -> DataFrame:
    """What the trimmed token ``v`` is as a number: kind flags, digits and scale.

    The steps are columns of their own, so that no pattern is matched twice.
    """
    c = F.col
    rows = rows.withColumn("wrapped", c("v").rlike(r"^\(.+\)$"))
    rows = rows.withColumn("body", F.trim(F.when(c("wrapped"), F.regexp_replace("v", r"^\(|\)$", "")).otherwise(c("v"))))
    rows = rows.withColumns({"bare": F.regexp_replace("body", "[$€£¥,_ ]", ""), "signed": c("body").rlike("[$€£¥]")})
    rows = rows.withColumns({"shaped": c("bare").rlike(SHAPE), **{f"p{i}": F.regexp_extract("bare", SHAPE, i) for i in range(1, 7)}})
    digits = F.length("p2") + F.length("p4")
    rows = rows.withColumns({"digits": digits, "plain": (c("p3") == "") & (c("p5") == ""), "raw_scale": F.length("p4") - F.when(c("p5") != "", c("p6").try_cast("int")).otherwise(F.lit(0))})
    leading_zero = c("plain") & (F.length("p2") > 1) & c("p2").startswith("0")
    rows = rows.withColumns({
        "number": c("shaped") & (c("digits") > 0) & ~(c("wrapped") & (c("p1") != "")) & ~leading_zero,
        "all_scale": F.greatest("raw_scale", F.lit(0)), "all_digits": c("digits") + F.greatest(-c("raw_scale"), F.lit(0)),
    })
    rows = rows.withColumn("whole_digits", F.greatest(c("all_digits") - c("all_scale"), F.lit(0)))
    rows = rows.withColumn("all_precision", F.greatest(c("whole_digits") + c("all_scale"), F.lit(1)))
    rows = rows.withColumn("over", (c("all_precision") > MAX_PRECISION) | (c("all_scale") > MAX_PRECISION))
    rows = rows.withColumns({"decimal": c("number") & ~c("plain"), "integer": c("number") & c("plain") & ~c("over")})
    return rows.withColumns({
        "float": c("number") & c("over"), "overflow": c("decimal") & c("over"), "currency": (c("integer") | c("decimal")) & c("all_scale").isin(0, 2, 4),
        "symbol": c("number") & (c("signed") | c("wrapped")), "precision": F.when(c("decimal"), c("all_precision")), "scale": F.when(c("decimal"), c("all_scale")),
        "decimal_digits": F.when(c("decimal"), c("whole_digits")), "integer_digits": F.when(c("integer"), c("whole_digits")),
    })


COUNTED = ("filled", "boolean", "integer", "decimal", "float", "overflow", "currency", "symbol", "date", "datetime", "time", "guid", "other")
LARGEST = ("precision", "scale", "decimal_digits", "integer_digits")


def votes(df: DataFrame) -> DataFrame:
    """One row a column of text: counts of what its cells could be. One aggregation pass."""
    names = df.columns
    long = df.select(*[F.trim(F.coalesce(quoted(c).cast("string"), F.lit(""))).alias(f"c{i}") for i, c in enumerate(names)])
    long = long.select(F.posexplode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("position", "v"))
    v = F.col("v")
    long = long.select("position", F.when((v != "") & ~is_placeholder(v), v).alias("v"))
    cells = numeric_tokens(long).withColumns({"filled": v.isNotNull(), "boolean": F.lower(v).isin(*BOOLEAN_WORDS)})
    rest = v.isNotNull() & ~F.col("boolean") & ~F.col("number")
    for name, reader in (("date", parse_date), ("datetime", parse_datetime), ("time", parse_time), ("guid", parse_guid)):
        cells = cells.withColumn("rest", rest).withColumn(name, F.when(F.col("rest"), reader(v).isNotNull()).otherwise(F.lit(False)))
        rest = F.col("rest") & ~F.col(name)
    cells = cells.withColumn("other", rest)
    per_cell = cells.select("position", *[F.coalesce(n, F.lit(False)).alias(n) for n in COUNTED], *LARGEST)
    counts = [F.count_if(F.col(n)).alias(n) for n in COUNTED]
    return per_cell.groupBy("position").agg(F.count(F.lit(1)).alias("rows"), *counts, *[F.max(n).alias(n) for n in LARGEST])


def decide(v) -> ColumnType:
    """The type that one column's votes choose."""
    most = lambda n: v[n] > 0 and 2 * v[n] > v["filled"]
    if not v["filled"] or v["other"]:
        return STRING
    if most("boolean"):
        return BOOLEAN
    if v["currency"] == v["filled"] and v["symbol"] * 100 >= v["filled"] * SYMBOL_PERCENT:
        return CURRENCY
    if v["decimal"]:
        spec = None if v["overflow"] else _decimal(v)
        return spec or FLOAT
    if most("integer"):
        digits = v["integer_digits"] or 0
        return ColumnType("decimal", digits, 0) if digits > 18 else INTEGER  # beyond 64 bits
    if most("currency") and v["symbol"]:
        return CURRENCY
    for name, kind in (("float", FLOAT), ("date", DATE), ("datetime", DATETIME), ("time", TIME), ("guid", GUID)):
        if most(name):
            return kind
    return STRING


def _decimal(v) -> ColumnType | None:
    scale = min(v["scale"] or 0, MAX_PRECISION)
    digits = max(v["decimal_digits"] or 0, v["integer_digits"] or 0)
    precision = max(digits + scale, 1, v["precision"] or 0)
    return ColumnType("decimal", precision, scale) if precision <= MAX_PRECISION else None


@dataclass
class Inference:
    """An inferred schema with what was seen on the way."""

    schema: Schema
    rows: int
    samples: list[str | None]
    observations: list[str]
    placeholders: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    undecoded: int = 0
    overrides: set[str] = field(default_factory=set)
    suggested: set[str] = field(default_factory=set)


def sampled(df: DataFrame, sample_rows: int) -> DataFrame:
    """The leading rows that inference reads (0: all), less repeated headers."""
    rows = df.where(~header_like_row([c for c in df.columns if c != UNDECODED]))
    return rows.limit(sample_rows) if sample_rows else rows


def infer_types(df: DataFrame, sample_rows: int = 2000) -> list[ColumnType]:
    found = {r.position: r for r in votes(sampled(df, sample_rows)).collect()}  # one row a column
    return [decide(found[i]) if i in found else STRING for i in range(len(df.columns))]


def placeholder_tally(df: DataFrame) -> DataFrame:
    """column, token, count of placeholder cells."""
    cells = df.select(*[F.trim(F.coalesce(quoted(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])
    long = cells.unpivot([], [quoted(c) for c in df.columns], "column", "token")
    return long.where(is_placeholder(F.col("token"))).groupBy("column", "token").agg(F.count(F.lit(1)).alias("count"))


def infer(df: DataFrame, *, sample_rows: int = 2000, has_headers: bool = True, overrides: Sequence[str] = (), mapping: bool = False) -> Inference:
    """Infer a schema from text columns, with samples, value counts and placeholders.

    A column ``UNDECODED`` counts the cells of a row that could not be decoded
    and were skipped; it is no column of the schema.
    """
    from quillframe.schema import apply_overrides

    rows = sampled(df, sample_rows)
    if sample_rows:
        rows = rows.persist()  # a bounded sample; a full scan is read again instead
    try:
        columns = [c for c in df.columns if c != UNDECODED]
        cells = rows.select(*[quoted(c) for c in columns])
        found = {r.position: r for r in votes(cells).collect()}
        types = [decide(found[i]) if i in found else STRING for i in range(len(columns))]
        schema = Schema([ColumnMeta(n, t) for n, t in zip(columns, types)], has_headers)
        samples, observations = _observe(cells)
        tally: dict[str, list[tuple[str, int]]] = {}
        for r in placeholder_tally(cells).orderBy("column", "token").collect():
            tally.setdefault(r.column, []).append((r.token, r["count"]))
        total = max((r.rows for r in found.values()), default=0)
        undecoded = rows.agg(F.sum(UNDECODED)).first()[0] or 0 if UNDECODED in df.columns else 0
    finally:
        if sample_rows:
            rows.unpersist()
    out = Inference(schema, total, samples, observations, tally, undecoded)
    out.overrides = apply_overrides(schema, overrides)
    if mapping:
        for c in schema.columns:
            name = snake_case(c.name)
            if name and name != c.name:
                c.rename = name
                out.suggested.add(c.name)
            c.mappings = [] if c.type == STRING else [Mapping(STRING, c.type)]
    return out


def _observe(rows: DataFrame) -> tuple[list[str | None], list[str]]:
    """A first value, and the first ``TRACKED`` distinct values with their counts, of each column.

    Empty cells and placeholders do not count. Each task keeps its own first
    distinct values, so no task sees more of a column than that.
    """
    if not rows.columns:
        return [], []
    cells = rows.select(F.monotonically_increasing_id().alias("at"), F.posexplode(F.array(*[F.trim(F.coalesce(quoted(c), F.lit(""))) for c in rows.columns])).alias("p", "v"))
    cells = cells.where((F.col("v") != "") & ~is_placeholder(F.col("v")))
    counts = cells.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    first = counts.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("at", "v"))).where(F.col("k") <= TRACKED)
    filled = {r.p: r["count"] for r in cells.groupBy("p").count().collect()}
    seen: dict[int, list] = {}
    for r in first.orderBy("p", "k").collect():  # at most TRACKED rows a column
        seen.setdefault(r.p, []).append((r.v, r.n))
    texts = []
    for p in range(len(rows.columns)):
        shown = [f"{v} ({n})" for v, n in seen.get(p, [])]
        other = filled.get(p, 0) - sum(n for _, n in seen.get(p, []))
        texts.append(", ".join(shown + ([f"other ({other})"] if other else [])))
    return [seen[p][0][0] if p in seen else None for p in range(len(rows.columns))], texts


def placeholder_replacements(found: Inference, behavior: str = "empty", fill: str = "") -> Schema:
    """The schema with replacements that empty or fill its placeholders."""
    if behavior not in ("empty", "fill"):
        raise UserError(f"unknown placeholder behavior {behavior!r}; use empty or fill")
    for c in found.schema.columns:
        known = {a for a, _ in c.replace}
        c.replace += [(t, fill if behavior == "fill" else "") for t, _ in found.placeholders.get(c.name, []) if t not in known]
    return found.schema


def format_hint(kind: ColumnType, sample: str | None) -> str:
    if not sample:
        return "—"
    if kind.kind in ("date", "datetime", "time"):
        from datetime import datetime

        for f in {"date": DATE_FORMATS, "datetime": DATETIME_FORMATS, "time": TIME_FORMATS}[kind.kind]:
            try:
                datetime.strptime(sample.strip(), f)
                return f
            except ValueError:
                continue
        return "—"
    if kind.kind in ("currency", "decimal", "float", "integer"):
        marks = [m for m, hit in (("symbol", re.search("[$€£¥]", sample)), ("parentheses", sample.strip().startswith("(")), ("thousands separator", "," in sample)) if hit]
        return ", ".join(marks) or "plain number"
    if kind.kind == "boolean":
        return sample.strip().lower() + " style"
    return "braced" if kind.kind == "guid" and sample.strip().startswith("{") else "—"


def probe_report(found: Inference, sample_rows: int) -> str:
    """The table of columns, the sample footer, the signature and the placeholders."""
    if not found.schema.columns:
        return "No columns inferred.\n"
    rows = []
    for i, c in enumerate(found.schema.columns):
        rename = (c.rename + (" (suggested)" if c.name in found.suggested else "")) if c.rename else "—"
        flags = [w for w, on in (("type", c.name in found.overrides), ("mapping", c.rename)) if on]
        sample = found.samples[i] if i < len(found.samples) else None
        cut = sample if sample is None or len(sample) <= 32 else sample[:31] + "…"
        rows.append([str(i + 1), c.name, str(c.type), rename, "+".join(flags) or "—", cut or "—", format_hint(c.type, sample), found.observations[i] or "—"])
    out = render_table(["#", "name", "type", "rename", "override", "sample", "format", "observations"], rows)
    scope = "full scan" if not sample_rows else f"sample of up to {sample_rows} rows"
    if found.undecoded:
        out += f"\nCells skipped because they could not be decoded: {found.undecoded}\n"
    out += f"\nRows read: {found.rows} ({scope})\nSignature: sha256:{found.schema.signature()}\n"
    if found.placeholders:
        out += "\nPlaceholders:\n" + "".join(f"  {c}: {', '.join(f'{t} ({n})' for t, n in tokens)}\n" for c, tokens in found.placeholders.items())
    return out


def schema_diff(old: str, new: str, path: str) -> str:
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"{path} (existing)", f"{path} (inferred)", n=3))
