"""Delimited files: reading as text columns, writing with quotes, delimiters and encodings."""

from __future__ import annotations

import codecs
import csv
import io
import os
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import UserError
from quillframe.operators.binding import quoted
from quillframe.operators.infer import LAYOUT_ROWS, UNDECODED, has_header, synthetic_names
from quillframe.schema import Schema
from quillframe.storage import shared_dir

DELIMITERS = {"tab": "\t", "comma": ",", "pipe": "|", "semicolon": ";"}
STDIN = "-"
BYTES = "iso-8859-1"  # reads every byte as one character
SPARK_NAMES = {"iso8859-1": "iso-8859-1", "ascii": "us-ascii", "utf-16-le": "utf-16le", "utf-16-be": "utf-16be"}
BOM = "\u00ef\u00bb\u00bf"


def delimiter(text: str) -> str:
    """A name or one ASCII character."""
    found = DELIMITERS.get(text.lower(), text)
    if len(found) != 1 or not found.isascii():
        raise UserError(f"delimiter {text!r} must be a name ({', '.join(DELIMITERS)}) or one ASCII character")
    return found


def input_delimiter(path: str, given: str | None = None) -> str:
    return delimiter(given) if given else "\t" if path.lower().endswith(".tsv") else ","


def output_delimiter(path: str | None, given: str | None, of_input: str) -> str:
    if given:
        return delimiter(given)
    ending = os.path.splitext(path or "")[1].lower()
    return {".tsv": "\t", ".csv": ","}.get(ending, of_input)


def encoding(label: str | None) -> str:
    """The name that Java and Python share for an encoding label."""
    try:
        return codecs.lookup(label or "utf-8").name
    except LookupError as e:
        raise UserError(f"unknown encoding {label!r}") from e


def spool_stdin(spark: SparkSession, stream=None) -> str:
    """Standard input as a file that can be split and read more than once.

    The file goes to the folder that driver and executors share.
    """
    with tempfile.NamedTemporaryFile("wb", suffix=".csv", delete=False) as out:
        shutil.copyfileobj(stream or sys.stdin.buffer, out)
    jvm = spark.sparkContext._jvm
    target = f"{shared_dir(spark)}/stdin-{uuid.uuid4().hex}.csv"
    path = jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{out.name}"), path)
    return target


def head_rows(spark: SparkSession, path: str, sep: str, code: str = "utf-8", rows: int = LAYOUT_ROWS) -> list[list[str]]:
    """The leading records of a file (a bounded number of them), split by the CSV rules."""
    first = spark.read.option("header", False).options(**_options(sep, _reads_as(spark, code))).csv(path).limit(rows).collect()
    found = [["" if v is None else v for v in r] for r in first]
    if code != "utf-8":
        return found
    if found and found[0]:
        found[0][0] = found[0][0].removeprefix(BOM)
    try:
        return [[v.encode("latin-1").decode("utf-8") for v in r] for r in found]
    except UnicodeDecodeError:  # told, or skipped, when the cells are read
        return [[v.encode("latin-1").decode("utf-8", "replace") for v in r] for r in found]


def _reads_as(spark: SparkSession, code: str) -> str:
    """What Spark reads a file as: UTF-8 as plain bytes, so that wrong ones can be told."""
    if code == "cp1252" and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise UserError("windows-1252 needs a session with spark.sql.legacy.javaCharsets=true")
    return BYTES if code == "utf-8" else SPARK_NAMES.get(code, code)


def _decoded(cell: Column, code: str) -> tuple[Column, Column]:
    """The text of a cell, and whether it could be decoded.

    UTF-8 is checked byte by byte, so U+FFFD in the input is text like any
    other. Other encodings are decoded by the reader, which puts U+FFFD for
    what it cannot decode; of them only UTF-16 and UTF-32 could hold one.
    """
    if code == "utf-8":
        text = F.encode(cell, "ISO-8859-1").cast("string")
        plain = F.octet_length(cell) == F.char_length(cell)  # ASCII alone
        return F.when(plain, cell).otherwise(text), F.when(plain, True).otherwise(F.call_function("is_valid_utf8", text))
    return cell, ~F.coalesce(cell, F.lit("")).contains("\ufffd")


def _options(sep: str, code: str) -> dict[str, str]:
    plain = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "emptyValue": "", "encoding": code, "columnPruning": "false"}
    return plain | {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}


def layout(spark: SparkSession, path: str, sep: str, code: str = "utf-8", assume_header: bool | None = None) -> tuple[list[str], bool]:
    """Column names and whether the file has a header row."""
    rows = head_rows(spark, path, sep, code)
    header = has_header(rows) if assume_header is None else assume_header
    if not rows:
        return [], header
    return (rows[0] if header else synthetic_names(len(rows[0]))), header


def read_delimited(
    spark: SparkSession, path: str, *, sep: str | None = None, code: str | None = None, schema: Schema | None = None, header: bool | None = None, columns: Sequence[str] | None = None,
    multiline: bool = True, undecoded: str = "fail",
) -> DataFrame:
    """Every cell as text; NULL and empty cells both read as empty text.

    ``multiline`` allows line breaks inside quoted fields; Spark then reads each
    file in one task, so turn it off for large files without such fields. A
    record with too few or too many fields fails the job, and so does a cell
    that cannot be decoded, unless ``undecoded`` is ``skip``: such cells are then
    empty, and a column ``UNDECODED`` counts them. Column names come from the
    header, the schema, or ``field_0``, ``field_1``, ...
    """
    sep, code = input_delimiter(path, sep), encoding(code)
    if columns is None:
        assumed = schema.has_headers if schema is not None and header is None else header
        columns, header = layout(spark, path, sep, code, assumed)
        if schema is not None and not header:
            columns = [c.name for c in schema.columns]
    if not columns:
        raise UserError(f"{path} has no columns")
    corrupt = "__corrupt"
    shape = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(columns))] + [T.StructField(corrupt, T.StringType())])
    options = _options(sep, _reads_as(spark, code)) | {"multiLine": str(multiline).lower()}
    raw = spark.read.schema(shape).options(**options, header=str(bool(header)).lower(), enforceSchema="true", mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt).csv(path)
    bad = F.raise_error(F.concat(F.lit("record with a wrong number of fields: "), F.col(corrupt))).cast("boolean")
    # Spark refuses to read the record column alone, so the check also looks at a field
    wrong = F.col(corrupt).isNotNull() & (F.length(F.coalesce("f0", F.lit(""))) >= 0)
    fine = raw.where(F.when(wrong, bad).otherwise(True))
    if code == "utf-8" and not header:
        fine = fine.withColumn("f0", F.regexp_replace("f0", f"^{BOM}", ""))
    cells, unread = [], F.lit(0)
    for i, c in enumerate(columns):
        text, ok = _decoded(F.col(f"f{i}"), code)
        if undecoded == "skip":
            cells.append(F.when(ok, F.coalesce(text, F.lit(""))).otherwise("").alias(c))
            unread = unread + F.when(ok | F.col(f"f{i}").isNull(), 0).otherwise(1)
        else:
            failed = F.raise_error(F.lit(f"column {c!r}: a cell cannot be decoded as {code}")).cast("string")
            cells.append(F.when(F.col(f"f{i}").isNull(), "").when(ok, text).otherwise(failed).alias(c))
    return fine.select(*cells, *([unread.alias(UNDECODED)] if undecoded == "skip" else []))


PARALLEL = {"utf-8": "utf-8", "ascii": "us-ascii", "iso8859-1": "iso-8859-1"}


def write_delimited(df: DataFrame, path: str, *, sep: str = ",", code: str | None = None, header: bool = True, single: bool = True) -> None:
    """All fields quoted. ``single`` gives one file at ``path``, else a folder of parts.

    Parts are written in parallel, in the order of the rows; for a single file
    the driver then joins their bytes. A character without a form in the
    encoding is an error. Encodings that Spark does not write go through the
    driver row by row.
    """
    code = encoding(code)
    out = df.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    if code not in PARALLEL:
        if not single:
            raise UserError(f"a folder of parts cannot be written as {code}")
        with open(path, "w", encoding=code, newline="") as f:
            write_rows(f, df.columns if header else None, out.toLocalIterator(), sep)
        return
    if code != "utf-8":
        bad = r"[^\x{0}-\x{7f}]" if code == "ascii" else r"[^\x{0}-\x{ff}]"
        for name in df.columns:
            if re.search(r"[^\x00-\x7f]" if code == "ascii" else r"[^\x00-\xff]", name):
                raise UserError(f"column name {name!r} has no {code} form")
        refused = F.raise_error(F.lit(f"a character has no {code} form")).cast("string")
        out = out.select(*[F.when(quoted(c).rlike(bad), refused).otherwise(quoted(c)).alias(c) for c in out.columns])
    options = {"sep": sep, "quote": '"', "escape": '"', "quoteAll": "true", "emptyValue": "", "nullValue": "", "encoding": PARALLEL[code], "header": str(header and not single).lower()}
    options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if not single:
        out.write.mode("overwrite").options(**options).csv(path)
        return
    where = path if "://" in path else "file://" + os.path.abspath(path)
    parts = f"{where}.parts-{uuid.uuid4().hex}" if "://" in path else f"{shared_dir(df.sparkSession)}/parts-{uuid.uuid4().hex}"
    try:
        out.write.options(**options).csv(parts)
        first = to_csv_text(df.columns, [], sep).encode(code) if header else b""
        _join_parts(df.sparkSession, parts, where, first)
    except Exception as e:
        if f"has no {code} form" in str(e):
            raise UserError(f"a character has no {code} form") from e
        raise
    finally:
        _files(df.sparkSession, parts).delete(_path(df.sparkSession, parts), True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Name, length and time of change of a file or of all files of a folder."""
    where = path if "://" in path else "file://" + os.path.abspath(path)
    files, at = _files(spark, where), _path(spark, where)
    found = files.listStatus(at)  # of a file: the file itself
    return ";".join(sorted(f"{f.getPath().getName()},{f.getLen()},{f.getModificationTime()}" for f in found))


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _join_parts(spark: SparkSession, parts: str, path: str, first: bytes) -> None:
    """The bytes of all part files, in the order of their names, after ``first``."""
    jvm = spark.sparkContext._jvm
    names = sorted(f.getPath().getName() for f in _files(spark, parts).listStatus(_path(spark, parts)))
    out = _files(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(first))
        for name in names:
            if name.startswith("part-"):
                part = _files(spark, parts).open(_path(spark, f"{parts}/{name}"))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                part.close()
    finally:
        out.close()
    _files(spark, path).delete(_path(spark, os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")), False)


def write_rows(stream, header: Sequence[str] | None, rows: Iterable[Sequence], sep: str = ",") -> None:
    """Rows to a text stream; an unmappable character is an error."""
    writer = csv.writer(stream, delimiter=sep, quoting=csv.QUOTE_ALL, lineterminator="\n")
    try:
        if header is not None:
            writer.writerow(header)
        for r in rows:
            writer.writerow(["" if v is None else v for v in r])
    except UnicodeEncodeError as e:
        raise UserError(f"character {e.object[e.start]!r} has no {e.encoding} form") from e


def to_csv_text(header: Sequence[str] | None, rows: Iterable[Sequence], sep: str = ",") -> str:
    out = io.StringIO()
    write_rows(out, header, rows, sep)
    return out.getvalue()
