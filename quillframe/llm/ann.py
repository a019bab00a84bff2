"""Nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Largest inner product becomes least distance by one more component,
sqrt(M^2 - |x|^2), where M is the largest norm; queries get 0 there. Vectors are
then projected to ``dims`` Gaussian (2-stable) sums. For one pair, the squared
projected distance over the squared true distance is chi-square with ``dims``
degrees of freedom.

A kd-tree over a bounded sample of projections cuts the projected space into
boxes, and every row is put into the box it falls in; boxes of many rows are
dealt by hash into blocks of about ``block_rows``. Each block keeps its vectors
and a kd-tree over their projections. A query first searches the box it falls in,
which bounds the distance of its k-th nearest, and then only the boxes that lie
within the stopping radius of that bound. In a block it walks the leaves by
projected distance, a few at a time, verifies the points it meets on the
original vectors, and stops when a point that lies farther out in projection
would have had to beat the chi-square quantile ``confidence`` to be among its k
nearest: so each true neighbour is found with at least that probability. The
blocks' lists merge to the k nearest.

The sample fits the boxes only: every row is indexed, and how the boxes fall
changes what a query costs, not what the test promises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import discard, materialise, table

LEAF = 64
START = 8  # leaves of the first step; later steps take as many again as all before


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection on the regularised lower incomplete gamma series."""

    def cdf(x):
        term = total = 1.0 / (k / 2)
        n = k / 2
        while term > total * 1e-12:
            n += 1
            term *= x / 2 / n
            total += term
        return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))

    lo, hi = 1e-9, 10.0 * k + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree over projected points, as a permutation and the boxes of its leaves."""

    def __init__(self, points: np.ndarray):
        self.order, bounds = np.arange(len(points)), []
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                bounds.append((a, b))
                continue
            part = points[self.order[a:b]]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.bounds = np.array(sorted(bounds))
        self.points = points[self.order]
        self.low = np.stack([self.points[a:b].min(axis=0) for a, b in self.bounds])
        self.high = np.stack([self.points[a:b].max(axis=0) for a, b in self.bounds])

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(0, np.maximum(self.low[None] - q[:, None], q[:, None] - self.high[None]))
        return (gap * gap).sum(axis=2)


class Boxes:
    """A kd-tree that cuts the projected space into ``leaves`` boxes by the medians of a sample."""

    def __init__(self, points: np.ndarray, leaves: int):
        depth = max(0, math.ceil(math.log2(max(1, leaves))))
        self.cuts: list[tuple[int, float]] = [(0, np.inf)] * ((1 << depth) - 1)
        self.count = 1 << depth
        dims = points.shape[1]
        self.low, self.high = np.full((self.count, dims), -np.inf), np.full((self.count, dims), np.inf)
        todo = [(0, points, np.full(dims, -np.inf), np.full(dims, np.inf))]
        while todo:
            node, part, low, high = todo.pop()
            if node >= len(self.cuts):
                self.low[node - len(self.cuts)], self.high[node - len(self.cuts)] = low, high
                continue
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(part) else 0
            cut = float(np.median(part[:, axis])) if len(part) else np.inf
            self.cuts[node] = (axis, cut)
            left = part[:, axis] < cut
            up, down = high.copy(), low.copy()
            up[axis], down[axis] = min(up[axis], cut), max(down[axis], cut)
            todo += [(2 * node + 1, part[left], low, up), (2 * node + 2, part[~left], down, high)]

    def of(self, points: np.ndarray) -> np.ndarray:
        """The box of each point."""
        node = np.zeros(len(points), np.int64)
        if not self.cuts:
            return node
        axis, cut = np.array([a for a, _ in self.cuts]), np.array([c for _, c in self.cuts])
        rows = np.arange(len(points))
        for _ in range(int(math.log2(self.count))):
            node = 2 * node + 1 + (points[rows, axis[node]] >= cut[node])
        return node - len(self.cuts)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distances of one point to all boxes."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class Space:
    """The lift and the projection that all rows and queries share."""

    def __init__(self, width: int, top: float, dims: int, seed: int = 3):
        self.width, self.top = width, top
        self.plane = np.random.default_rng(seed).standard_normal((width + 1, dims))

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        norms = np.einsum("ij,ij->i", vectors, vectors)
        return np.hstack([vectors, np.sqrt(np.maximum(0, self.top - norms))[:, None]]) @ self.plane

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.plane[:-1]

    def array(self, column) -> np.ndarray:
        """Vectors of a list column, shorter ones filled up with zeros."""
        out = np.zeros((len(column), self.width))
        for i, v in enumerate(column):
            out[i, : len(v)] = v
        return out


def search_block(queries, query_rows, bounds, vectors, ids, rows, space: Space, k: int, stop: float):
    """(query index, vector index, score) of the k best found in one block for each query.

    ``bounds`` are squared true distances within which a query still looks for
    neighbours (infinite at first); ``rows`` and ``query_rows`` name rows.
    """
    tree = Tree(space.rows(vectors))
    vectors, ids, rows, points = vectors[tree.order], ids[tree.order], rows[tree.order], tree.points
    flat = space.queries(queries)
    q_norms = np.einsum("ij,ij->i", queries, queries)
    sizes = tree.bounds[:, 1] - tree.bounds[:, 0]
    out = []
    for i, q in enumerate(queries):
        reach = tree.leaf_distances(flat[i : i + 1])[0]
        leaves = np.argsort(reach, kind="stable")
        best_s, best_r = np.empty(0), np.empty(0, np.int64)
        at, step, worst = 0, START, bounds[i]  # squared true distance of the k-th nearest so far
        while at < len(leaves) and reach[leaves[at]] <= stop * worst:
            part = leaves[at : at + step]
            part = part[reach[part] <= stop * worst]
            met = np.repeat(tree.bounds[part, 0] - (np.cumsum(sizes[part]) - sizes[part]), sizes[part]) + np.arange(sizes[part].sum())
            if np.isfinite(worst):
                far = points[met] - flat[i]
                met = met[np.einsum("ij,ij->i", far, far) <= stop * worst]
            met = met[rows[met] != query_rows[i]]
            best_s = np.concatenate([best_s, (vectors[met] * q).sum(axis=1)])
            best_r = np.concatenate([best_r, met])
            if len(best_s) > k:
                keep = np.lexsort((ids[best_r], -best_s))[:k]
                best_s, best_r = best_s[keep], best_r[keep]
            if len(best_s) >= k:
                worst = min(worst, max(0.0, q_norms[i] + space.top - 2 * best_s.min()))
            at, step = at + step, at + step
        out.append((np.full(len(best_s), i), tree.order[best_r], best_s))
    return [np.concatenate(x) for x in zip(*out)]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: no null, non-finite or only zero components."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where("vec_id is not null and embedding is not null").where(fine).select("vec_id", v.alias("v"))


def pack(rows: DataFrame, keys: list[str], space: Space, name: str) -> DataFrame:
    """One row a block: keys, and as bytes the ids, row numbers, vectors and bounds of its rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable")
        data = [group["vec_id"].to_numpy(np.int64), group["row"].to_numpy(np.int64), space.array(group["v"].tolist()), group["bound"].to_numpy(np.float64)]
        made = {key: [group[key].iloc[0]] for key in keys}
        return pd.DataFrame(made | {f"{name}_{part}": [x.tobytes()] for part, x in zip(("ids", "rows", "data", "bounds"), data)})

    fields = ", ".join([*(f"{key} long" for key in keys), *(f"{name}_{part} binary" for part in ("ids", "rows", "data", "bounds"))])
    return rows.groupBy(*keys).applyInPandas(run, fields)


def searched(asked: DataFrame, packed: DataFrame, space: Space, k: int, stop: float) -> DataFrame:
    """(query_row, query_id, vec_id, row, score): the k best of each query in each block of its boxes.

    ``asked`` has packed queries by box and part, ``packed`` packed rows by box
    and block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q_rows, bounds = (np.frombuffer(r[c], t) for c, t in (("q_ids", np.int64), ("q_rows", np.int64), ("q_bounds", np.float64)))
                ids, rows = np.frombuffer(r["x_ids"], np.int64), np.frombuffer(r["x_rows"], np.int64)
                q, x = (np.frombuffer(r[c]).reshape(-1, space.width) for c in ("q_data", "x_data"))
                i, j, s = search_block(q, q_rows, bounds, x, ids, rows, space, k, stop)
                columns = [q_rows[i], q_ids[i], ids[j], rows[j], s]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "vec_id", "row", "score"])

    work = asked.join(packed, "box")
    dealt = work.repartition(F.xxhash64("box", "part", "block"))
    return dealt.mapInArrow(run, "query_row long, query_id long, vec_id long, row long, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, dims: int = 24, confidence: float = 0.93, block_rows: int = 8192, query_rows: int = 4096, sample_rows: int = 16_384
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found of each query.

    ``vectors`` has vec_id and embedding. Queries are the rows whose vec_id is
    divisible by ``every``, each row for itself; a query's own row is no
    candidate, other rows of the same id are. Null or zero vectors and those
    with a null or non-finite component take no part; shorter vectors count as
    filled up with zeros. Ties go to the smaller vec_id; with fewer candidates
    than k all are returned. An empty table gives an empty result; other columns
    are ignored, whatever their names. ``sample_rows`` bounds the sample that
    fits the boxes, of which there are at most ``sample_rows / 16``.
    """
    rows = materialise(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda n, x: n + x * x)
    total, width, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    space, stop = Space(width or 1, top or 0.0, dims), chi_square_quantile(confidence, dims)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(2)), "row").limit(sample_rows).select("v").collect()
    boxes = Boxes(space.rows(space.array([r.v for r in sample])), min(math.ceil(total / block_rows), sample_rows // 16))
    context = rows.sparkSession.sparkContext
    shipped = context.broadcast((space, boxes))  # at most sample_rows / 16 boxes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, boxes = shipped.value
        for batch in batches:
            x = space.array(batch.column(1).to_pylist())
            box = boxes.of(space.rows(x)) if len(x) else np.empty(0, np.int64)
            home = boxes.of(space.queries(x)) if len(x) else box
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(box), pa.array(home)], names=["vec_id", "v", "row", "box", "home"])

    placed = materialise(rows.mapInArrow(place, "vec_id long, v array<double>, row long, box long, home long"), "placed")
    discard(rows)
    boxed = placed.groupBy("box").count()
    parts = {r.box: math.ceil(r["count"] / block_rows) for r in boxed.collect()}  # one row a box
    known = context.broadcast(parts)
    filled = sorted(parts)
    most = placed.sparkSession.createDataFrame([(b, n) for b, n in parts.items()], "box long, blocks long")
    block = F.pmod(F.xxhash64("row", F.lit(1)), "blocks")
    packed = materialise(pack(placed.join(F.broadcast(most), "box").select("box", block.alias("block"), "vec_id", "row", "v", F.lit(0.0).alias("bound")), ["box", "block"], space, "x"), "blocks")

    def queries_of(visits: DataFrame) -> DataFrame:
        sizes = visits.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("parts"))  # one row a box
        dealt = visits.join(F.broadcast(sizes), "box").withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), "parts")).drop("parts")
        return pack(dealt, ["box", "part"], space, "q")

    asking = placed.where(f"vec_id % {every} = 0")
    at_home = asking.select(F.col("home").alias("box"), "vec_id", "row", "v", F.lit(float("inf")).alias("bound"))
    first = materialise(best_of(searched(queries_of(at_home), packed, space, k, stop), k), "first")
    enough = first.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    bound = F.greatest(F.lit(0.0), F.aggregate("v", F.lit(0.0), lambda n, x: n + x * x) + F.lit(space.top) - 2 * F.col("least"))
    bounded = asking.join(enough, asking["row"] == enough["query_row"], "left").select("vec_id", "v", "row", "home", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, boxes = shipped.value
        there = np.array(sorted(known.value), np.int64)
        for batch in batches:
            x = space.array(batch.column(1).to_pylist())
            flat, home, limit = space.queries(x), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for i in range(len(x)):
                far = boxes.distances(flat[i])[there]
                to = there[(far <= stop * limit[i]) & (there != home[i])]
                one = batch.slice(i, 1).take(pa.array(np.zeros(len(to), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(to), one.column(0), one.column(2), one.column(1), one.column(4)], names=["box", "vec_id", "row", "v", "bound"])

    if len(filled) > 1:
        visits = bounded.mapInArrow(visit, "box long, vec_id long, row long, v array<double>, bound double")
        visits = materialise(visits, "visits")
        first = best_of(first.drop("rank").unionByName(searched(queries_of(visits), packed, space, k, stop)), k)
    return first.select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir):
    """The 20 nearest of every query row of ``embeddings``: query_id, rank, vec_id, score; see ``nearest``."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
