"""Sort acceleration: pre-clustered Parquet variants with a manifest.

A variant is the table range-partitioned and sorted by its keys, so its files
follow each other in key order and rows of equal keys share a file. A request
whose leading sort keys match a variant reads that variant's files instead of
the input. With a limit it reads only the first files, as many as it takes:
their row counts stand in a table beside the variant. Row groups carry narrow
min/max ranges of the keys, so range filters on them prune most row groups.

The manifest names the state of the input; an index of another state is refused.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillframe.errors import UserError
from quillframe.operators.binding import ORDINAL, bind, quoted, with_ordinal
from quillframe.operators.filters import compile_filters, uses_row_number
from quillframe.operators.transform import SortKey, parse_sort, process
from quillframe.schema import Schema

VERSION = 3
MANIFEST = "manifest"
#: A variant has at least so many files that each holds about as many rows, so that the memory of a task is bounded.
ROWS_A_FILE = 1_000_000


@dataclass(frozen=True)
class Variant:
    """Named leading sort keys."""

    name: str
    keys: tuple[SortKey, ...]

    def describe(self) -> str:
        return f"{self.name} -> " + ", ".join(f"{k.column}:{'asc' if k.ascending else 'desc'}" for k in self.keys)

    def matches(self, sort: Sequence[SortKey]) -> bool:
        return tuple(sort[: len(self.keys)]) == self.keys


def _default_name(keys: Sequence[SortKey]) -> str:
    return "_".join(f"{re.sub('[^A-Za-z0-9_]', '_', k.column)}-{'asc' if k.ascending else 'desc'}" for k in keys)


def parse_variant(spec: str) -> Variant:
    """``[name=]column[:asc|desc],...``"""
    name, found, rest = spec.partition("=")
    if found and not name.strip():
        raise UserError(f"variant {spec!r} has no name before '='")
    keys = parse_sort([rest if found else spec])
    if not keys:
        raise UserError(f"variant {spec!r} has no columns")
    return Variant(name.strip() if found else _default_name(keys), tuple(keys))


def expand_covering(spec: str) -> list[Variant]:
    """``[prefix=]column[:asc|desc][|...],...``: every leading part times every choice of directions."""
    name, found, rest = spec.partition("=")
    if found and (not name.strip() or not rest.strip()):
        raise UserError(f"covering {spec!r} needs a name and columns around '='")
    options = []
    for token in (t.strip() for t in (rest if found else spec).split(",")):
        if not token:
            continue
        column, _, directions = token.partition(":")
        ways = [d.strip().lower() for d in directions.split("|") if d.strip()] or ["asc"]
        if not column.strip() or set(ways) - {"asc", "desc"}:
            raise UserError(f"bad covering column {token!r}")
        options.append([SortKey(column.strip(), w == "asc") for w in ways])
    if not options:
        raise UserError(f"covering {spec!r} has no columns")
    out = []
    for n in range(1, len(options) + 1):
        for keys in itertools.product(*options[:n]):
            label = _default_name(keys)
            out.append(Variant(f"{re.sub('[^A-Za-z0-9_]', '_', name.strip())}_{label}" if found else label, keys))
    return out


def variants_of(columns: Sequence[str] = (), specs: Sequence[str] = (), coverings: Sequence[str] = ()) -> list[Variant]:
    found = []
    if columns:
        found.append(Variant(_default_name(keys := parse_sort(columns)), tuple(keys)))
    found += [parse_variant(s) for s in specs] + [v for c in coverings for v in expand_covering(c)]
    if not found:
        raise UserError("an index needs columns, a spec or a covering")
    if len({v.name for v in found}) < len(found):
        found = list({v.name: v for v in found}.values())
    return found


def best_variant(variants: Sequence[Variant], sort: Sequence[SortKey]) -> Variant | None:
    """The longest match; the first of equals."""
    return max((v for v in variants if v.matches(sort)), key=lambda v: len(v.keys), default=None)


def build(df: DataFrame, path: str, variants: Sequence[Variant], schema: Schema | None = None, limit: int | None = None, partitions: int | None = None, source: str | None = None) -> "Index":
    """Write every variant under ``path`` and the manifest last.

    Typed key columns ``__k<i>`` follow mapping and replacement; NULL keys stay.
    ``partitions`` is the least number of files; larger inputs get more.
    ``source`` names the state of the input (``delimited.fingerprint``).
    """
    rows = with_ordinal(df)
    if limit:
        rows = rows.where(F.col(ORDINAL) <= limit)
    bound, total = bind(rows, schema), rows.count()
    least = max(partitions or 0, -(-total // ROWS_A_FILE))
    if not partitions and least <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        least = 0  # as many as the session makes
    for v in variants:
        keys = [bound.field(k.column).typed for k in v.keys]
        keyed = bound.df.select(*[quoted(c) for c in rows.columns], *[c.alias(f"__k{i}") for i, c in enumerate(keys)])
        order = [F.col(f"__k{i}").asc_nulls_first() if k.ascending else F.col(f"__k{i}").desc_nulls_last() for i, k in enumerate(v.keys)]
        placed = keyed.repartitionByRange(least, *order) if least else keyed.repartitionByRange(*order)
        placed.sortWithinPartitions(*order, F.col(ORDINAL).asc()).write.mode("overwrite").parquet(f"{path}/{v.name}")
        files = df.sparkSession.read.parquet(f"{path}/{v.name}").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        files.coalesce(1).write.mode("overwrite").parquet(f"{path}/{v.name}.files")  # one row a file
    manifest = {
        "version": VERSION, "rows": total, "partial": bool(limit), "source": source, "columns": [c for c in df.columns if c != ORDINAL],
        "variants": [{"name": v.name, "keys": [[k.column, k.ascending] for k in v.keys]} for v in variants],
    }
    df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{MANIFEST}")
    return load(df.sparkSession, path)


@dataclass(frozen=True)
class Index:
    """A loaded manifest."""

    spark: SparkSession
    path: str
    variants: tuple[Variant, ...]
    columns: tuple[str, ...]
    rows: int
    partial: bool
    source: str | None = None

    def check(self, source: str) -> None:
        """Refuse an index that was built from another state of the input."""
        if self.source is not None and self.source != source:
            raise UserError("the input has changed since the index was built; rebuild the index")

    def pick(self, sort: Sequence[SortKey], pinned: str | None = None) -> Variant | None:
        if pinned is None:
            return best_variant(self.variants, sort)
        found = next((v for v in self.variants if v.name == pinned), None)
        if found is None:
            raise UserError(f"index has no variant {pinned!r}; it has {', '.join(v.name for v in self.variants)}")
        if not sort or not found.matches(sort):
            raise UserError(f"variant {found.describe()} does not match the requested sort")
        return found

    def read(self, variant: Variant, allow_partial: bool = False) -> DataFrame:
        """The clustered rows with their input ordinal, so later sorts break ties as before."""
        return self._rows(variant, self._schema(variant, allow_partial))

    def _schema(self, variant: Variant, allow_partial: bool) -> StructType:
        if self.partial and not allow_partial:
            raise UserError("the index holds only the first rows of its input; rebuild it without a limit")
        return self.spark.read.parquet(f"{self.path}/{variant.name}").schema

    def _rows(self, variant: Variant, schema: StructType, files: Sequence[str] | None = None) -> DataFrame:
        """All rows of a variant, or those of some of its files."""
        paths = [f"{self.path}/{variant.name}"] if files is None else [f"{self.path}/{variant.name}/{f}" for f in files]
        return self.spark.read.schema(schema).parquet(*paths).drop(*[f"__k{i}" for i in range(len(variant.keys))])

    def process(self, variant: Variant, schema: Schema | None = None, allow_partial: bool = False, **how) -> DataFrame:
        """``transform.process`` over the variant; a limited result reads only the first files that it needs.

        Rows of equal leading keys share a file, so a row of a later file sorts
        after all rows of the earlier ones. With filters, the files are taken
        in steps that double, until enough rows pass.
        """
        shape, limit = self._schema(variant, allow_partial), how.get("limit")
        if limit is None:
            return process(self._rows(variant, shape), schema, **how)
        files = sorted((r.file, r.rows) for r in self.spark.read.parquet(f"{self.path}/{variant.name}.files").collect())
        filters, exprs = how.get("filters", ()), how.get("filter_exprs", ())
        taken = 0
        while taken < len(files):
            if not filters and not exprs:
                upto = list(itertools.accumulate(n for _, n in files))
                taken = min(len(files), bisect.bisect_left(upto, limit) + 1)
                break
            taken = min(len(files), max(1, 2 * taken))
            bound = bind(self._rows(variant, shape, [f for f, _ in files[:taken]]), schema, mappings=not how.get("skip_mappings", False))
            passing = bound.df
            for predicate in compile_filters(bound, filters, exprs, F.col(ORDINAL) if uses_row_number(exprs) else None):
                passing = passing.where(predicate)
            if passing.limit(limit).count() >= limit:
                break
        chosen = None if taken == len(files) else [f for f, _ in files[: max(1, taken)]]
        return process(self._rows(variant, shape, chosen), schema, **how)

    def describe(self) -> str:
        return "\n".join(v.describe() for v in self.variants)


def load(spark: SparkSession, path: str) -> Index:
    raw = json.loads(spark.read.text(f"{path}/{MANIFEST}").first()[0])
    if raw.get("version") != VERSION:
        raise UserError(f"index version {raw.get('version')} is not supported; rebuild the index")
    variants = tuple(Variant(v["name"], tuple(SortKey(c, a) for c, a in v["keys"])) for v in raw["variants"])
    return Index(spark, path, variants, tuple(raw["columns"]), raw["rows"], raw["partial"], raw.get("source"))
