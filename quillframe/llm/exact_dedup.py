"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition sorts its rows by digest and keeps one entry a digest
(smallest identifier, count): a run. Runs are numbered, and in each round
``fan_in`` neighbouring runs (those that share ``run // fan_in``) exchange their
entries, sort them together by (run, digest) and merge equal digests in one
pass over the sorted entries, keeping the smallest identifier and the sum of the
counts. Every round's runs are written, sorted, before the next starts. After
ceil(log_fan_in(runs)) rounds one run is left, spread over tasks by digest. A
hot digest is one entry a run from the start, so no task meets more than
``fan_in`` entries of it.

Identifiers are (doc_id, row key) pairs. The rule "largest doc_id stays" is the
smallest identifier under descending order; ``keep`` chooses. Entries are
verified: the key is the SHA-256 digest, the text's length in bytes and an
independent 64-bit hash, so that two texts that shared a SHA-256 value still
would not merge.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import ascii_lower, discard, keep_rows, materialise, row_key, spread_join, table

KEY = ("digest", "bytes", "check")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, bytes, check, k1, k2, run) of every row; null text counts as empty."""
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    low = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"), k1.alias("k1"), k2.alias("k2"))
    return low.select(
        "doc_id",
        F.unhex(F.sha2(F.col("low").cast("binary"), 256)).alias("digest"),
        F.octet_length("low").alias("bytes"),
        F.xxhash64("low").alias("check"),
        "k1", "k2",
        F.spark_partition_id().alias("run"),
    )


def merge_runs(rows: DataFrame, keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """Merge the runs of ``rows`` to one entry (key, best, group_size) a digest.

    ``best`` is (rank, doc_id, k1, k2) of the row that stays; a row without an
    id comes last. Its aggregate works on sorted entries: Spark sorts each run
    by digest and merges equal neighbours.
    """
    known = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    pick = F.max if keep == "largest" else F.min
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    entries = rows.select("run", *KEY, F.struct(known.alias("rank"), "doc_id", "k1", "k2").alias("best"), F.lit(1).cast("long").alias("group_size"))
    merge = lambda e: e.groupBy("run", *KEY).agg(pick("best").alias("best"), F.sum("group_size").alias("group_size")).sortWithinPartitions("run", *KEY)
    level = materialise(merge(entries), "runs")
    for _ in range(math.ceil(math.log(runs, fan_in) - 1e-9)):
        after = materialise(merge(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))), "runs")
        discard(level)
        level = after
    return level.drop("run")


def grouped(docs: DataFrame, id_col: str, text_col: str, keep: str, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """The digests of all rows and the merged entries, as tables."""
    rows = materialise(digest_rows(docs, id_col, text_col), "digests")
    return rows, merge_runs(rows, keep, fan_in)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. Null text
    counts as empty, so null and empty texts form one group. A repeated row
    (same id, same text) counts in ``group_size`` each time and is kept
    wherever its id is the group's; a null id is kept only in a group without
    any id. An empty table gives an empty result. Texts of any length are
    digested whole. Other columns are ignored, whatever their names.
    """
    rows, groups = grouped(docs, id_col, text_col, keep, fan_in)
    several = groups.where("group_size > 1").select(*KEY, F.col("best.doc_id").alias("keep_id"), "group_size")
    joined = spread_join(rows, several, KEY, several.withColumnRenamed("group_size", "n"), rows.count(), ["k1", "doc_id", "run"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one whose id ``exact_dedup`` keeps.

    Rows are told apart by id and text together. So rows that share an id but
    not a text stay, of rows that repeat both one stays, and of a group without
    any id one stays. All columns pass unchanged.
    """
    rows, groups = grouped(docs, id_col, text_col, keep, fan_in)
    return keep_rows(docs, groups.select("best.k1", "best.k2"), rows, [id_col, text_col])


def op10_exact_dedup(spark, sf_dir):
    """Per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256; see ``exact_dedup``."""
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT doc_id, sha256({LOWER_SQL}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept,
       h AS text_sha256
FROM d
"""
