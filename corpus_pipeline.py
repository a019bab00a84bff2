"""A training corpus from ``documents``, in five stages.

Every stage is a function of (spark, docs, sf_dir). What it returns is written
as Parquet in the shared folder and read back as the next stage's ``docs``.
All stages keep rows apart by their content, so rows without a doc_id, rows
that share one and repeated rows pass like any others; columns of any name
pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm.byte_cnn import fit_quality, score_quality
from quillframe.llm.common import free_names, materialise, table
from quillframe.llm.exact_dedup import drop_copies
from quillframe.llm.mixing import take_copies
from quillframe.llm.near_dedup import Plan, drop_near_copies
from quillframe.llm.pieces import encode_checked

LEAST_QUALITY = 0.3
NEAR = Plan(percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``LEAST_QUALITY``.

    Null and empty texts score alike; repeated rows stay or go together; an
    empty table stays empty.
    """
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    (score,) = free_names(docs, "__quality")
    return score_quality(docs, net, score_col=score).where(f"{score} >= {LEAST_QUALITY}").drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal text (null counts as empty), the one with the largest doc_id; see ``drop_copies``."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component (similarity of ``NEAR``, 0.80), the row with the smallest doc_id.

    Texts without words all stay; see ``drop_near_copies``.
    """
    return drop_near_copies(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of sources takes it; see ``take_copies``."""
    return take_copies(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every taken row: doc_id, n_pieces, ids, lossless.

    Null and empty texts have no pieces; repeated rows get equal ones.
    """
    return encode_checked(docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("pieces", pieces)]

#: The classifier, the draws of the mix and the sampled pieces are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
