"""The command line: schema, index, process, append, stats, join."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillframe.errors import UserError
from quillframe.operators import cluster, combine, infer, stats, verify
from quillframe.operators.transform import listed, parse_sort, process
from quillframe.plans.render import render_table
from quillframe.schema import Schema, manual_schema
from quillframe.sources import delimited as D
from quillframe.types import ColumnType

LOG = logging.getLogger("quillframe")
PREVIEW_ROWS = 10


def session() -> SparkSession:
    builder = SparkSession.builder.appName("quillframe").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    return builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.legacy.javaCharsets", "true").getOrCreate()


def normalize_argv(argv: Sequence[str]) -> list[str]:
    """``--report-invalid:a:b`` as ``--report-invalid a b``."""
    out: list[str] = []
    for a in argv:
        out += ["--report-invalid", *[p for p in a.split(":")[1:] if p]] if a.startswith("--report-invalid:") else [a]
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillframe")
    verbs = p.add_subparsers(dest="verb", required=True)

    def reading(v, many: bool = False):
        v.add_argument("--input", "-i", required=True, action="append" if many else "store")
        v.add_argument("--delimiter")
        v.add_argument("--input-encoding")
        v.add_argument("--no-multiline", dest="multiline", action="store_false", help="no field holds a line break, so that large files are read in parallel")

    schema = verbs.add_parser("schema")
    schema.add_argument("--output", "--schema", "-o", "-m", dest="output")
    schema.add_argument("--column", "-c", action="append", default=[])
    schema.add_argument("--replace", action="append", default=[])
    kinds = schema.add_subparsers(dest="mode")
    for name in ("probe", "infer"):
        v = kinds.add_parser(name)
        reading(v)
        v.add_argument("--sample-rows", type=int, default=2000)
        v.add_argument("--mapping", action="store_true")
        v.add_argument("--override", action="append", default=[])
        v.add_argument("--snapshot")
        v.add_argument("--na-behavior", choices=("empty", "fill"), default="empty")
        v.add_argument("--na-fill", default="")
        v.add_argument("--assume-header", type=lambda t: t.lower() == "true", default=None)
        if name == "infer":
            v.add_argument("--output", "--schema", "-o", "-m", dest="output")
            v.add_argument("--replace-template", action="store_true")
            v.add_argument("--preview", action="store_true")
            v.add_argument("--diff")
    v = kinds.add_parser("verify")
    v.add_argument("--schema", "--meta", "-m", required=True)
    reading(v, many=True)
    v.add_argument("--report-invalid", nargs="*", default=None)
    kinds.add_parser("columns").add_argument("--schema", "--meta", "-m", required=True)

    v = verbs.add_parser("index")
    reading(v)
    v.add_argument("--index", "-o", required=True)
    v.add_argument("--columns", "-C", action="append", default=[])
    v.add_argument("--spec", action="append", default=[])
    v.add_argument("--covering", action="append", default=[])
    v.add_argument("--schema", "-m")
    v.add_argument("--limit", type=int)

    v = verbs.add_parser("process")
    reading(v)
    for flags in (["--output", "-o"], ["--schema", "-m"], ["--index", "-x"], ["--index-variant"], ["--output-delimiter"], ["--output-encoding"]):
        v.add_argument(*flags)
    for flags in (["--sort"], ["--columns", "-C"], ["--exclude-columns"], ["--derive"], ["--filter"], ["--filter-expr"]):
        v.add_argument(*flags, action="append", default=[])
    v.add_argument("--limit", type=int)
    v.add_argument("--boolean-format", default="original", choices=("original", "true-false", "one-zero"))
    for flag in ("--row-numbers", "--preview", "--table", "--apply-mappings", "--skip-mappings"):
        v.add_argument(flag, action="store_true")

    v = verbs.add_parser("append")
    reading(v, many=True)
    for flags in (["--output", "-o"], ["--schema", "-m"], ["--output-encoding"]):
        v.add_argument(*flags)

    v = verbs.add_parser("stats")
    reading(v)
    v.add_argument("--schema", "-m")
    for flags in (["--columns", "-C"], ["--filter"], ["--filter-expr"]):
        v.add_argument(*flags, action="append", default=[])
    v.add_argument("--limit", type=int, default=0)
    v.add_argument("--frequency", action="store_true")
    v.add_argument("--top", type=int, default=0)

    v = verbs.add_parser("join")
    for flag in ("--left", "--right", "--left-key", "--right-key"):
        v.add_argument(flag, required=True)
    v.add_argument("--type", choices=combine.JOINS, default="inner")
    for flag in ("--output", "--left-schema", "--right-schema", "--delimiter", "--left-encoding", "--right-encoding", "--output-encoding"):
        v.add_argument(flag, *(["-o"] if flag == "--output" else []))
    v.add_argument("--no-multiline", dest="multiline", action="store_false", help="no field holds a line break, so that large files are read in parallel")
    return p


def _schema(path: str | None) -> Schema | None:
    return Schema.load(path) if path else None


def _path(spark, path: str) -> str:
    return D.spool_stdin(spark) if path == D.STDIN else path


def _read(spark, path: str, sep: str | None, code: str | None, schema: Schema | None, multiline: bool = True) -> DataFrame:
    header = True if path == D.STDIN and schema is None else None
    return D.read_delimited(spark, _path(spark, path), sep=sep, code=code, schema=schema, header=header, multiline=multiline)


def _emit(df: DataFrame, output: str | None, sep: str, code: str | None, as_table: bool = False) -> None:
    if output:
        D.write_delimited(df, output, sep=sep, code=code)
    elif as_table:
        sys.stdout.write(render_table(df.columns, [["" if v is None else str(v) for v in r] for r in df.toLocalIterator()]))
    else:
        D.write_rows(sys.stdout, df.columns, df.toLocalIterator(), sep)


def run_schema(spark, a) -> None:
    if a.mode is None:
        if not a.output:
            raise UserError("--output is required")
        manual_schema(a.column, a.replace).save(a.output)
    elif a.mode == "columns":
        sys.stdout.write(render_table(["#", "name", "type", "output"], Schema.load(a.schema).listing()))
    elif a.mode == "verify":
        run_verify(spark, a)
    else:
        run_infer(spark, a)


def run_verify(spark, a) -> None:
    schema, report = Schema.load(a.schema), verify.Report.parse(a.report_invalid)
    for path in a.input:
        rows = _read(spark, path, a.delimiter, a.input_encoding, schema, a.multiline)
        if not (report.detail or report.summary):
            verify.assert_valid(rows, schema)
            continue
        found = verify.violations(rows, schema).persist()
        total = found.count()
        if total and report.detail:
            shown = verify.details(found, report.limit).collect() if report.limit is not None else verify.details(found).toLocalIterator()
            body = [[str(r.row), r.column, r.raw, f"\x1b[31m{r.normalized}\x1b[0m", r.datatype, r.reason] for r in shown]
            sys.stdout.write(render_table(["row", "column", "raw", "normalized", "datatype", "reason"], body))
        if total and report.summary:
            sys.stdout.write(render_table(["column", "errors"], [[r.column, str(r.errors)] for r in verify.summary(found).collect()]))
        if total:
            raise UserError(f"Found {total} invalid value(s) in {path}")


def run_infer(spark, a) -> None:
    path, sep = _path(spark, a.input), D.input_delimiter(a.input, a.delimiter)
    code = D.encoding(a.input_encoding)
    columns, header = D.layout(spark, path, sep, code, True if a.input == D.STDIN and a.assume_header is None else a.assume_header)
    rows = D.read_delimited(spark, path, sep=sep, code=code, header=header, columns=columns, multiline=a.multiline, undecoded="skip")
    found = infer.infer(rows, sample_rows=a.sample_rows, has_headers=header, overrides=a.override, mapping=a.mapping)
    report = infer.probe_report(found, a.sample_rows)
    if a.snapshot:
        check_snapshot(a.snapshot, report)
    if a.mode == "probe":
        sys.stdout.write(report)
        return
    schema = infer.placeholder_replacements(found, a.na_behavior, a.na_fill)
    text = schema.to_yaml(a.replace_template)
    if a.diff:
        old = Path(a.diff).read_text(encoding="utf-8")
        sys.stdout.write(infer.schema_diff(old, text, a.diff) or "No changes.\n")
    if a.preview:
        sys.stdout.write(text)
    elif a.output:
        schema.save(a.output, a.replace_template)
    elif not a.diff:
        raise UserError("--output, --preview or --diff is required")


def check_snapshot(path: str, report: str) -> None:
    """Write the report if there is none, else insist on the same text."""
    file = Path(path)
    if not file.exists():
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(report, encoding="utf-8")
    elif file.read_text(encoding="utf-8") != report:
        raise UserError(f"the report differs from snapshot {path}")


def run_index(spark, a) -> None:
    if a.input == D.STDIN:
        raise UserError("index cannot read standard input")
    schema = _schema(a.schema)
    variants = cluster.variants_of(a.columns, a.spec, a.covering)
    rows = _read(spark, a.input, a.delimiter, a.input_encoding, schema, a.multiline)
    index = cluster.build(rows, a.index, variants, schema, a.limit, source=D.fingerprint(spark, a.input))
    LOG.info("index %s: %s", a.index, "; ".join(index.describe().splitlines()))


def run_process(spark, a) -> None:
    if a.preview and a.output:
        raise UserError("--preview and --output exclude each other")
    schema, sort = _schema(a.schema), parse_sort(a.sort)
    sep = D.input_delimiter(a.input, a.delimiter)
    if a.index_variant and not (a.index and sort):
        raise UserError("--index-variant needs --index and --sort")
    limit = a.limit if a.limit is not None or not a.preview else PREVIEW_ROWS
    how = dict(
        columns=a.columns, exclude=a.exclude_columns, derive=a.derive, filters=a.filter, filter_exprs=a.filter_expr, sort=a.sort, limit=limit, row_numbers=a.row_numbers,
        boolean_format=a.boolean_format, apply_mappings=a.apply_mappings, skip_mappings=a.skip_mappings, strict=True, as_text=True,
    )
    out = None
    if a.index and sort:
        index = cluster.load(spark, a.index)
        if variant := index.pick(sort, a.index_variant):
            if a.input == D.STDIN:
                raise UserError("an indexed sort cannot read standard input")
            index.check(D.fingerprint(spark, a.input))
            out = index.process(variant, schema, **how)
    if out is None:
        out = process(_read(spark, a.input, sep, a.input_encoding, schema, a.multiline), schema, **how)
    _emit(out, a.output, D.output_delimiter(a.output, a.output_delimiter, sep), a.output_encoding, a.table or a.preview)


def run_append(spark, a) -> None:
    schema = _schema(a.schema)
    frames, header = [], True
    for path in a.input:
        if schema is None:
            sep, code = D.input_delimiter(path, a.delimiter), D.encoding(a.input_encoding)
            local = _path(spark, path)
            columns, header = D.layout(spark, local, sep, code, True if path == D.STDIN else None)
            frames.append(D.read_delimited(spark, local, sep=sep, code=code, header=header, columns=columns, multiline=a.multiline))
        else:
            frames.append(_read(spark, path, a.delimiter, a.input_encoding, schema, a.multiline))
            header = schema.has_headers
    out, sep = combine.append(frames, schema), D.input_delimiter(a.input[0], a.delimiter)
    sep = D.output_delimiter(a.output, None, sep)
    if a.output:
        D.write_delimited(out, a.output, sep=sep, code=a.output_encoding, header=header)
    else:
        D.write_rows(sys.stdout, out.columns if header else None, out.toLocalIterator(), sep)


def run_stats(spark, a) -> None:
    schema = _schema(a.schema)
    if a.input == D.STDIN and schema is None:
        raise UserError("stats from standard input needs a schema")
    rows = _read(spark, a.input, a.delimiter, a.input_encoding, schema, a.multiline)
    if schema is None:
        schema = infer.placeholder_replacements(infer.infer(rows, sample_rows=0))
    how = {"columns": a.columns, "filters": a.filter, "filter_exprs": a.filter_expr, "limit": a.limit, "strict": True}
    if a.frequency:
        found = stats.frequency(rows, schema, top=a.top, **how).orderBy("column", "rank")
        body = [[r.column, r.value, str(r["count"]), f"{r.percent:.2f}%"] for r in found.toLocalIterator()]
        sys.stdout.write(render_table(["column", "value", "count", "percent"], body))
        return
    types: dict[str, ColumnType] = {c.output: c.type for c in schema.columns}
    sys.stdout.write(render_table(*stats.summary_table(stats.summarize(rows, schema, **how), types)))


def run_join(spark, a) -> None:
    if a.right == D.STDIN:
        raise UserError("the right input of a join cannot be standard input")
    left_schema, right_schema = _schema(a.left_schema), _schema(a.right_schema)
    if a.left == D.STDIN and left_schema is None:
        raise UserError("a left input from standard input needs a schema")
    left = _read(spark, a.left, a.delimiter, a.left_encoding, left_schema, a.multiline)
    right = _read(spark, a.right, a.delimiter, a.right_encoding, right_schema, a.multiline)
    left_schema = left_schema or infer.infer(left, sample_rows=0).schema
    right_schema = right_schema or infer.infer(right, sample_rows=0).schema
    out = combine.join(left, right, listed([a.left_key]), listed([a.right_key]), a.type, left_schema, right_schema)
    _emit(out, a.output, D.input_delimiter(a.left, a.delimiter), a.output_encoding)


VERBS = {"schema": run_schema, "index": run_index, "process": run_process, "append": run_append, "stats": run_stats, "join": run_join}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one verb; 0 on success, 1 on failure. Start, end and seconds are logged."""
    logging.basicConfig(level=os.environ.get("QUILLFRAME_LOG", "WARNING").upper(), stream=sys.stderr, format="%(levelname)s %(message)s")
    args = parser().parse_args(normalize_argv(sys.argv[1:] if argv is None else argv))
    began = time.time()
    outcome = "failed"
    LOG.info("%s started", args.verb)
    try:
        VERBS[args.verb](spark or session(), args)
        outcome = "succeeded"
        return 0
    except UserError as e:
        sys.stderr.write(f"error: {e}\n")
        return 1
    except Exception as e:  # Spark wraps a failed cell in its own error
        sys.stderr.write(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}\n")
        LOG.debug("details", exc_info=True)
        return 1
    finally:
        LOG.info("%s %s in %.3f s", args.verb, outcome, time.time() - began)


if __name__ == "__main__":
    sys.exit(main())
