"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import discard, materialise, spread_join


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = spread_join(both, least.drop("n"), ["u"], least.drop("m"), 2 * total, ["v"])
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = spread_join(down, least.drop("n"), ["u"], least.drop("m"), total, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v): the smallest node reachable.

    Null ends and self links are dropped; no links give an empty result. Every
    star is written as a table, so lineage stays short, and the one before it is
    deleted. Minima are aggregated before the shuffle and joined back, hubs in
    parts, so that a hub is never one task's list.
    """
    edges = materialise(links.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        large = materialise(_large_star(edges, state[0]), "stars")
        small = materialise(_small_star(large, state[0]), "stars")
        discard(edges, large)
        edges, after = small, _state(small)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
