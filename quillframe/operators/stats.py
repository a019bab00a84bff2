"""Summary statistics and frequency counts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.errors import UserError
from quillframe.functions.cells import render_cell
from quillframe.operators.binding import ORDINAL, Bound, Field, bind, quoted, with_ordinal
from quillframe.operators.filters import compile_filters, uses_row_number
from quillframe.operators.transform import listed
from quillframe.schema import Schema
from quillframe.storage import numbered
from quillframe.types import NUMERIC, TEMPORAL, ColumnType

METRICS = ("count", "min", "max", "mean", "median", "std_dev")
EPOCH_CE = dt.date(1970, 1, 1).toordinal()
EMPTY = "<empty>"


def metric(field: Field) -> Column:
    """The number that is aggregated: days for dates, seconds for times."""
    k = field.type.kind
    if k == "date":
        return F.unix_date(field.typed).cast("double")
    if k == "datetime":
        return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), field.typed).cast("double")
    return field.typed.cast("double")


def stat_fields(bound: Bound, columns: Sequence[str]) -> list[Field]:
    wanted = listed(columns)
    able = (*NUMERIC, *TEMPORAL)
    if not wanted:
        fields = [f for f in bound.fields if f.type.kind in able]
        if not fields:
            raise UserError("no numeric or temporal columns to summarise")
        return fields
    fields = list(dict.fromkeys(bound.field(c) for c in wanted))
    for f in fields:
        if f.type.kind not in able:
            raise UserError(f"column {f.output!r} has type {f.type}, which has no statistics")
    return fields


def selected_rows(df: DataFrame, schema: Schema | None, filters, filter_exprs, limit: int, strict: bool, header_like: bool = True) -> tuple[Bound, DataFrame]:
    """Rows that statistics see: the first ``limit`` input rows (0: all), less repeated headers, filtered."""
    if limit or uses_row_number(filter_exprs):
        df = with_ordinal(df)
    bound = bind(df, schema)
    rows = bound.checked() if strict else bound.df
    if limit:
        rows = rows.where(F.col(ORDINAL) <= limit)
    if header_like and schema is not None:
        from quillframe.operators.infer import header_like_row

        rows = rows.where(~header_like_row([f.name for f in bound.fields]))
    number = F.col(ORDINAL) if ORDINAL in df.columns else None
    for predicate in compile_filters(bound, filters, filter_exprs, number):
        rows = rows.where(predicate)
    return bound, rows


def summarize(df: DataFrame, schema: Schema | None = None, *, columns: Sequence[str] = (), filters: Sequence[str] = (), filter_exprs: Sequence[str] = (), limit: int = 0, strict: bool = False) -> DataFrame:
    """column, count, min, max, mean, median, std_dev, scale: one row a column.

    One pass gives all but the median, and for each median a bracket of values
    around it; where that is not one value, a second pass counts the values in
    the brackets.

    Values are doubles: of dates, days since 1970; of datetimes, seconds since
    1970; of times, seconds of the day. ``std_dev`` is the sample deviation,
    NULL below two values. ``scale`` is the largest scale seen of exact types.
    """
    bound, rows = selected_rows(df, schema, filters, filter_exprs, limit, strict)
    fields = stat_fields(bound, columns)
    rows = rows.select(*[metric(f).alias(f"m{i}") for i, f in enumerate(fields)], *[_scale(f).alias(f"s{i}") for i, f in enumerate(fields)])
    aggregates = []
    for i, _ in enumerate(fields):
        m = F.col(f"m{i}")
        deviation = F.when(F.count(m) > 1, F.greatest(F.stddev_samp(m), F.lit(0.0)))
        aggregates += [a.alias(f"{n}{i}") for n, a in zip((*METRICS[:4], "std_dev"), (F.count(m), F.min(m), F.max(m), F.avg(m), deviation))]
        aggregates += [F.max(f"s{i}").alias(f"scale{i}"), F.percentile_approx(m, [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY).alias(f"bracket{i}")]
    one = rows.agg(*aggregates).first()  # one row
    medians = _medians(rows, [(one[f"count{i}"], *(one[f"bracket{i}"] or (None, None))) for i in range(len(fields))])
    lines = [(f.output, *[medians[i] if n == "median" else one[f"{n}{i}"] for n in METRICS], one[f"scale{i}"]) for i, f in enumerate(fields)]
    return df.sparkSession.createDataFrame(lines, "column string, count long, min double, max double, mean double, median double, std_dev double, scale int")


ACCURACY, BRACKET = 10_000, 2e-4  # a bracket's ends are off by at most 1 / ACCURACY of the rows


def _medians(rows: DataFrame, brackets: list[tuple[int, float | None, float | None]]) -> list[float | None]:
    """The exact medians of the columns m<i>, from (count, low, high) with low <= median <= high.

    Only values between low and high are told apart; those below are counted.
    So what one column's window sees is a small, fixed share of its rows.
    """
    out: list[float | None] = [low if n and low == high else None for n, low, high in brackets]
    open_ = [i for i, (n, _, _) in enumerate(brackets) if n and out[i] is None]
    if not open_:
        return out
    places, wanted = [], F.lit(False)
    for i in open_:
        n, low, high = brackets[i]
        m = F.col(f"m{i}")
        place = F.when(m < low, F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v")))
        places.append(place.when(m <= high, F.struct(F.lit(i).alias("i"), m.alias("v"))))
        middle = (F.col("upto") - F.col("count") < n // 2 + 1) & (F.col("upto") > (n - 1) // 2)  # one of its places is a middle one
        wanted = wanted | ((F.col("i") == i) & F.col("v").isNotNull() & middle)
    counts = rows.select(F.explode(F.array_compact(F.array(*places))).alias("p")).select("p.*").groupBy("i", "v").count()
    ranked = counts.withColumn("upto", F.sum("count").over(Window.partitionBy("i").orderBy(F.col("v").asc_nulls_first())))
    found: dict[int, list] = {}
    for r in ranked.where(wanted).collect():  # at most two rows a column
        found.setdefault(r.i, []).append((r.v, r.upto))
    value = lambda k, at: next((v for v, upto in at if upto >= k), None)
    for i in open_:
        n, at = brackets[i][0], sorted(found.get(i, []), key=lambda p: p[1])
        low, high = value((n - 1) // 2 + 1, at), value(n // 2 + 1, at)
        if low is None or high is None:  # the bracket missed a middle place: look at all values
            low = high = _medians(rows, [(n if j == i else 0, float("-inf"), float("nan")) for j in range(len(brackets))])[i]
        out[i] = low if low == high else 0.5 * low + 0.5 * high
    return out


def _scale(f: Field) -> Column:
    if f.type.kind == "currency":
        own = f.scale if f.scale is not None else F.when(f.typed == f.typed.cast("decimal(28,2)"), 2).otherwise(4)
        return F.when(f.typed.isNotNull(), F.when(own == 4, 4).otherwise(2))
    if f.type.kind == "decimal":
        return F.when(f.typed.isNotNull(), F.lit(f.type.scale))
    return F.lit(None).cast("int")


def _number_text(value: float) -> str:
    if value != value or value in (float("inf"), float("-inf")):
        return ""
    return f"{value:.0f}" if value == int(value) else f"{value:.4f}"


def metric_text(value: float | None, kind: ColumnType, scale: int | None) -> str:
    """A metric in the column's own notation."""
    if value is None:
        return ""
    k = kind.kind
    if k == "currency":
        return f"{value:.{4 if scale == 4 else 2}f}"
    if k == "decimal":
        return f"{value:.{kind.scale if scale is None else scale}f}"
    if k == "date":
        return (dt.date.fromordinal(EPOCH_CE) + dt.timedelta(days=_half_up(value))).isoformat()
    if k == "datetime":
        return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=_half_up(value))).strftime("%Y-%m-%d %H:%M:%S")
    if k == "time":
        s = min(86399, max(0, _half_up(value)))
        return f"{s // 3600:02}:{s % 3600 // 60:02}:{s % 60:02}"
    return _number_text(value)


def _half_up(value: float) -> int:
    return int(abs(value) + 0.5) * (1 if value >= 0 else -1)


def deviation_text(value: float | None, kind: ColumnType, scale: int | None) -> str:
    if value is None:
        return ""
    if kind.kind in TEMPORAL:
        return f"{_number_text(value)} {'days' if kind.kind == 'date' else 'seconds'}"
    return metric_text(value, kind, scale)


def summary_table(result: DataFrame, types: dict[str, ColumnType]) -> tuple[list[str], list[list[str]]]:
    """Headers and text rows; one row a column, so the collect is bounded by the schema."""
    out = []
    for r in result.collect():
        kind = types[r.column]
        out.append([r.column, str(r["count"]), *[metric_text(r[n], kind, r.scale) for n in METRICS[1:5]], deviation_text(r.std_dev, kind, r.scale)])
    return ["column", *METRICS], out


def frequency_text(field: Field) -> Column:
    if field.type.kind == "float":
        v = field.typed
        text = F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(F.format_string("%.4f", v))
    else:
        text = render_cell(field.typed, field.type, field.scale)
    return F.coalesce(text, F.lit(EMPTY))


def frequency(df: DataFrame, schema: Schema | None = None, *, columns: Sequence[str] = (), filters: Sequence[str] = (), filter_exprs: Sequence[str] = (), limit: int = 0, top: int = 0, strict: bool = False) -> DataFrame:
    """column, value, count, percent, rank: counts of rendered values, most frequent first.

    ``percent`` is of the rows that survive the filters. Ranks are per column
    by count, then value; ``top`` keeps that many values of each (0: all).
    """
    bound, rows = selected_rows(df, schema, filters, filter_exprs, limit, strict)
    wanted = listed(columns)
    fields = list(dict.fromkeys(bound.field(c) for c in wanted)) if wanted else list(bound.fields)
    texts = rows.select(*[frequency_text(f).alias(f.output) for f in fields])
    long = texts.unpivot([], [quoted(f.output) for f in fields], "column", "value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    if top:
        order = Window.partitionBy("column").orderBy(F.desc("count"), "value")  # each task keeps its top first
        totals = F.broadcast(counts.groupBy("column").agg(F.sum("count").alias("total")))  # one row a column
        ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals, "column")
    else:
        placed = numbered(counts.orderBy("column", F.desc("count"), "value"), "place")  # sorted by range, over all tasks
        totals = F.broadcast(placed.groupBy("column").agg(F.sum("count").alias("total"), F.min("place").alias("first")))
        ranked = placed.join(totals, "column").withColumn("rank", F.col("place") - F.col("first") + 1)
    return ranked.select("column", "value", "count", F.round(F.col("count") * 100.0 / F.col("total"), 2).alias("percent"), F.col("rank").cast("bigint").alias("rank"))
