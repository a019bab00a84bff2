"""The registered queries, their oracles, and short forms to register them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.operators.transform import process

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(name: str, **options):
    """``process`` over one table; keys are unique, so no ordinals are needed."""
    return lambda spark, d: process(table(spark, d, name), stable=False, **options)
