"""Helpers shared by the corpus operators: tables, columns from Python, row keys, joins on hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from quillframe.storage import PART, WITHIN, discard, materialise, numbered, shared_dir

__all__ = [
    "MASK64", "UPPER", "ascii_lower", "bound_batches", "discard", "extend", "free_names", "held_out", "keep_rows", "labelled_sample", "materialise", "numbered",
    "occurrence", "row_key", "sampled_crops", "shared_dir", "slices", "splitmix", "spread_join", "table",
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MASK64 = (1 << 64) - 1
SLICE_BYTES = 4 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark has to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, whose texts take about ``most`` bytes; a longer text is a part of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches hold ``rows`` rows, unless the session's owner chose a number.

    Spark's own default is 10,000 rows or 64 MB, which JVM and worker hold
    several times over. The number is read when a plan runs, so it cannot be
    put back while results are still to be computed.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def extend(df: DataFrame, reads: Sequence[str], added: Sequence[StructField], make: Callable[[], Callable], keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (or only its columns ``keep``) with columns that Python computes.

    ``make()`` is called once a task and gives a function from lists of the
    columns ``reads`` (a text column first) to the added columns. The other
    columns pass as Arrow arrays and are not touched; columns that are not kept
    do not travel back from Python.
    """
    bound_batches(df.sparkSession)
    names = df.columns
    kept = [i for i, c in enumerate(names) if keep is None or c in keep]
    fields = [*(df.schema.fields[i] for i in kept), *added]
    kinds = [to_arrow_type(f.dataType) for f in added]
    at = [names.index(c) for c in reads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, at[0]):
                found = compute(*[part.column(i).to_pylist() for i in at])
                new = [pa.array(v, k) for v, k in zip(found, kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *new], names=[f.name for f in fields])

    return df.mapInArrow(run, StructType(fields))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(*columns: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that name a row by the given columns, nulls included."""
    parts = [p for c in columns for p in (F.isnull(c), F.coalesce(c.cast("string"), F.lit("")))]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], counts: DataFrame, total: int, by: Sequence[str], how: str = "inner", most: int = 256) -> DataFrame:
    """Join ``big`` to ``small``, which has one row a key, without a task for every hot key.

    ``counts`` has the rows of ``big`` for each key as ``n``, ``total`` is their
    sum. A key with more than ``total / most`` rows is hot; at most ``most``
    keys can be, so their list is broadcast. Its rows are dealt by a hash of
    ``by`` over as many parts as that share fits in, and its row of ``small``
    goes to each part.
    """
    share = max(1.0, total / most)
    hot = F.broadcast(counts.where(F.col("n") > share).select(*on, F.ceil(F.col("n") / share).cast("int").alias("__parts")))
    dealt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")), F.lit(0).cast("bigint"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("__parts") - 1, F.lit(0)).cast("bigint")))
    left = big.join(hot, list(on), "left").withColumn("__salt", dealt).drop("__parts")
    right = small.join(hot, list(on), "left").withColumn("__salt", every).drop("__parts")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def occurrence(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with the number of every row among the rows of equal ``keys`` (not null), from 0.

    Rows are numbered in their partition, and the counts of the earlier
    partitions added, so that a key of any size is never in one task.
    """
    placed = materialise(df.withColumns({PART: F.spark_partition_id(), WITHIN: F.monotonically_increasing_id()}), "occurrences")
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = placed.groupBy(PART, *keys).count().withColumn("__before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(WITHIN)) - 1
    return placed.withColumn(name, within).join(before, [PART, *keys]).withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def keep_rows(docs: DataFrame, kept: DataFrame, rows: DataFrame, columns: Sequence[str], also: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (k1, k2), one for each key, and all for which ``also`` holds.

    ``rows`` has the keys (``row_key`` of ``columns``) of all rows of ``docs``.
    Texts move once, in a shuffled hash join, at every size; only rows whose
    key occurs more than once are compared.
    """
    a, b, flag = free_names(docs, "__k1", "__k2", "__kept")
    k1, k2 = row_key(*[docs[c] for c in columns])
    keyed = docs.withColumns({a: k1, b: k2, flag: F.lit(False) if also is None else F.coalesce(also, F.lit(False))})
    named = lambda d: d.select(F.col("k1").alias(a), F.col("k2").alias(b))
    times = materialise(rows.join(kept, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")), "kept")
    once, twice = named(times.where("n = 1")), named(times.where("n > 1"))
    if also is None:
        out = keyed.join(once.hint("shuffle_hash"), [a, b], "left_semi")
    else:
        found = once.withColumn(flag + "_", F.lit(True)).hint("shuffle_hash")
        out = keyed.join(found, [a, b], "left").where(F.col(flag) | F.col(flag + "_")).drop(flag + "_")
    if not twice.isEmpty():
        out = out.unionByName(keyed.where(~F.col(flag)).join(twice, [a, b], "left_semi").dropDuplicates([a, b]))
    return out.drop(a, b, flag)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is much faster than ``translate`` but also maps other alphabets,
    so it serves only the texts that are pure ASCII.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled_crops(docs: DataFrame, ids: DataFrame, max_chars: int) -> DataFrame:
    """One crop of ``max_chars`` characters, at a hashed offset, for each row of ``ids`` (doc_id and more).

    ``ids`` has a bounded number of rows and is broadcast. Of several rows with
    one id, one text is taken, so that the result has at most one row for each
    row of ``ids``.
    """
    length = F.length("text")
    start = F.when(length > max_chars, F.pmod(F.xxhash64("doc_id"), length - max_chars)).otherwise(F.lit(0)) + 1
    crop = F.substring(F.col("text"), start.cast("int"), F.lit(max_chars)).alias("text")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select(*ids.columns, crop)
    return found.groupBy(*ids.columns).agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled training texts of each class, on the driver.

    The sample is the labelled ids outside the held-out fifth with the smallest
    hashes, so reruns agree. It is bounded by ``2 * per_class`` rows however
    often an id is repeated; of a longer text one crop of ``max_chars``
    characters at a hashed offset is learned from. Scoring always covers whole
    texts.
    """
    known = F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ids = labels.where(known).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    order = F.xxhash64("doc_id", F.lit(label))
    picked = None
    for y in (0, 1):
        one = ids.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    rows = sampled_crops(docs, picked, max_chars).collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.y))]


def label_share(labels: DataFrame, label: str) -> float:
    """The share of label 1 among the training labels of known documents; 0.5 without any."""
    known = F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    found = labels.where(known).agg(F.avg(label).alias("share")).first().share
    return 0.5 if found is None else found


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
