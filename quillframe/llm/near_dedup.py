"""Near-duplicate detection by MinHash banding, verified and joined to components.

1. Every text becomes the set of its distinct ``shingle``-word shingles (64-bit
   hashes), ``bands * rows`` universal hash minima of that set, and a 128-bit
   digest of it. Rows with equal sets form one class, a node with a number of
   its own, whether they have an id or not; copies never meet each other again.
2. Classes that agree on all ``rows`` minima of a band share a bucket. With 32
   bands of 5 rows two sets of similarity 0.85 share none with probability
   7e-9. In each bucket every member is paired with one pivot (the member that
   sits in the most and largest buckets): linear in the bucket, however large.
3. Pairs are verified on the signatures (estimate within 6.5 standard
   deviations of the threshold, which a pair at it misses with probability
   below 1e-8) and then on full sets.
4. Links become components by large-star and small-star.
5. Buckets that still hold several components may hide links that do not touch
   the pivot. Their members outside the bucket's largest component are compared
   with all its members, in blocks: first the signatures, in large blocks, which
   only mark the members that have a candidate at all, then the full sets of
   those, where a matrix product over the shared shingles counts all intersections at once.
   Only links that join components leave a task. No cap drops a pair.

Hot buckets, pivots and classes are dealt over several tasks by ``spread_join``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from quillframe.llm.common import UPPER, discard, extend, keep_rows, materialise, row_key, splitmix, spread_join, table
from quillframe.llm.components import components

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


@dataclass(frozen=True)
class Plan:
    """Shingle length, link threshold in per cent of the union, banding, and what one block of the last step holds."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    block: int = 256
    block_shingles: int = 400_000
    block_signatures: int = 4096

    @property
    def least_agreeing(self) -> int:
        """Signature positions that must agree: the threshold less 6.5 standard deviations."""
        k, s = self.bands * self.rows, self.percent / 100
        return max(1, int(np.floor(k * s - 6.5 * np.sqrt(k * s * (1 - s)))))


class WordHashes(dict):
    """xxh3 of a word's bytes, remembered; forgets everything when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: WordHashes, shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; few words make one shingle, none an empty set."""
    parts = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    with np.errstate(over="ignore"):
        if len(h) < shingle:
            acc = np.uint64(len(h))
            for x in h:
                acc = splitmix(np.array([acc * np.uint64(0x9E3779B97F4A7C15) + x]))[0]
            return np.array([acc], np.uint64)
        n = len(h) - shingle + 1
        acc = np.full(n, shingle, np.uint64)
        for k in range(shingle):
            acc = acc * np.uint64(0xD1342543DE82EF95) + h[k : k + n]
    return np.unique(splitmix(acc))


def hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of k multiply-shift functions, universal from 64 to 32 bits."""
    draws = splitmix(np.arange(2 * k, dtype=np.uint64) + np.uint64(20_240_601))
    return draws[:k] | np.uint64(1), draws[k:]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 128):
            np.minimum(best, (shingles[at : at + 128, None] * a + b).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, d1, d2, sig, bands) of every row; empty sets have null digest, sig and bands."""

    def make():
        words, (a, b) = WordHashes(), hash_family(plan.bands * plan.rows)
        seeds = splitmix(np.arange(plan.bands, dtype=np.uint64))

        def one(text):
            s = shingle_set(text, words, plan.shingle)
            if not len(s):
                return 0, None, None, None, None
            sig = minima(s, a, b)
            with np.errstate(over="ignore"):
                key = seeds.copy()
                for row in sig.reshape(plan.bands, plan.rows).T.astype(np.uint64):
                    key = splitmix(key * np.uint64(0x9E3779B97F4A7C15) + row)
                d1 = splitmix(s).sum(dtype=np.uint64)
            d2 = np.bitwise_xor.reduce(splitmix(s ^ np.uint64(0x5851F42D4C957F2D)))
            return len(s), int(d1.view(np.int64)), int(d2.view(np.int64)), sig.tobytes(), key.view(np.int64)

        return lambda texts: list(zip(*map(one, texts)))

    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")
    added = [StructField("n_shingles", LongType()), StructField("d1", LongType()), StructField("d2", LongType()), StructField("sig", BinaryType()), StructField("bands", ArrayType(LongType()))]
    return extend(keyed, ["text"], added, make, keep=["doc_id", "k1", "k2"])


def full_sets(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """(node, n, shingles) of the classes in ``wanted`` (node, k1, k2), from one text of each."""

    def make():
        words = WordHashes()

        def run(texts, nodes):
            sets = [shingle_set(t, words, plan.shingle).view(np.int64) for t in texts]
            return nodes, [len(s) for s in sets], sets

        return run

    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    texts = docs.select("text", k1.alias("k1"), k2.alias("k2")).join(wanted, ["k1", "k2"])
    added = [StructField("node", LongType()), StructField("n", LongType()), StructField("shingles", ArrayType(LongType()))]
    sets = materialise(extend(texts.select("text", F.col("node").alias("of")), ["text", "of"], added, make, keep=[]), "sets")
    if sets.groupBy("node").count().where("count > 1").isEmpty():
        return sets
    return materialise(sets.dropDuplicates(["node"]), "sets")  # rows that repeat both id and text


def agreeing(pairs: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v, su, sv) whose signatures agree often enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                u = np.frombuffer(b"".join(frame["su"]), np.uint32).reshape(len(frame), -1)
                v = np.frombuffer(b"".join(frame["sv"]), np.uint32).reshape(len(frame), -1)
                frame = frame[(u == v).sum(axis=1) >= plan.least_agreeing]
            yield frame[["u", "v"]]

    return pairs.mapInPandas(run, "u long, v long")


def linked(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) whose full sets meet the threshold."""
    left = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("shingles").alias("xu"))
    right = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("shingles").alias("xv"))
    both = F.size(F.array_intersect("xu", "xv"))
    near = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * plan.percent
    hubs = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return (
        spread_join(pairs.join(left, "u"), right, ["v"], hubs, pairs.count(), ["u"]).where(near)
        .withColumn("both", both)
        .where(F.col("both") * 100 >= (F.col("nu") + F.col("nv") - F.col("both")) * plan.percent)
        .select("u", "v")
    )


def _block_candidates(plan: Plan):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The members of one block that may link to a member of another component in it."""
        sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group), -1)
        comp, stray = group["component"].to_numpy(), np.nonzero(group["stray"].to_numpy())[0]
        hit = np.zeros(len(group), bool)
        for i in stray:
            near = ((sig == sig[i]).sum(axis=1) >= plan.least_agreeing) & (comp != comp[i])
            if near.any():
                hit |= near
                hit[i] = True
        return group.loc[hit, ["key", "node"]].drop_duplicates()

    return run


def _block_links(plan: Plan):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Spanning links between the components of one block pair."""
        group = group.drop_duplicates(["node"]).reset_index(drop=True)
        sets, size, comp = list(group["shingles"]), group["n"].to_numpy(np.float64), group["component"].to_numpy()
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        rank = np.cumsum(shared) - 1
        use = shared[token]
        owner, token = owner[use], rank[token[use]]
        inter = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        for at in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
            lo, hi = np.searchsorted(token, [at, at + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[owner[lo:hi], token[lo:hi] - at] = 1
            inter += m @ m.T
        hit = inter * 100 >= (size[:, None] + size[None, :] - inter) * plan.percent
        hit &= comp[:, None] != comp[None, :]
        top = {c: c for c in comp}

        def root(c):
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        links = []
        for i, j in zip(*np.nonzero(np.triu(hit, 1))):
            p, q = root(comp[i]), root(comp[j])
            if p != q:
                top[p] = q
                links.append((group["node"][i], group["node"][j]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def near_classes(docs: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and for each class of equal sets its component.

    Classes are (d1, d2, n_shingles, copies, first): ``first`` is (no_id,
    doc_id, k1, k2) of the component's row with the smallest id.
    """
    docs = docs.select("doc_id", "text")
    rows = materialise(sketches(docs, plan), "sketches")
    first = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "k1", "k2")
    classes = rows.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    every = nodes.count()

    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialise(spread_join(banded, buckets, ["key"], buckets.withColumnRenamed("m", "n"), every * plan.bands, ["node"]), "members")
    weight = members.groupBy("node").agg(F.sum("m").alias("w"))
    pivots = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", (-F.col("node")).alias("neg"))).alias("p"), F.first("m").alias("n"))
    stars = spread_join(members, pivots.select("key", (-F.col("p.neg")).alias("pivot")), ["key"], pivots.select("key", "n"), members.count(), ["node"])
    met = materialise(stars.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), "met")

    sig = nodes.select("node", "sig")
    hubs = met.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    signed = spread_join(met.join(sig.toDF("u", "su"), "u"), sig.toDF("v", "sv"), ["v"], hubs, met.count(), ["u"])
    pairs = materialise(agreeing(signed, plan), "pairs")
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", "first.k1", "first.k2"), "node")
    sets = full_sets(docs, wanted, plan)
    found = components(linked(pairs, sets, plan))
    discard(met, pairs, sets)

    extra = residual_links(docs, nodes, members, found, plan)
    if not extra.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v").unionByName(extra))
    placed = nodes.select("node", "d1", "d2", "n_shingles", "copies", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("least"))
    out = materialise(placed.drop("first").join(least, "component").select("d1", "d2", "n_shingles", "copies", F.col("least").alias("first")), "classes")
    discard(members, nodes)
    return rows, out


def near_dedup(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents link where the shingle sets of their lower-cased (A-Z) words
    overlap by ``plan.percent`` of the union; ``component_id`` is the smallest
    doc_id reachable. Null and empty texts and texts without words have 0
    shingles, link with nothing and are their own component. Every row is a
    document: repeated rows and equal sets are linked, rows that share only an
    id are not. Rows without a doc_id link like others and carry links on; their
    component is null if no row in it has an id, and they are not kept. An
    empty table gives an empty result; long texts are read whole; other columns
    are ignored.
    """
    rows, classes = near_classes(docs, plan)
    by_class = classes.select("d1", "d2", "n_shingles", F.col("first.doc_id").alias("component_id"))
    counts = classes.select("d1", "d2", "n_shingles", F.col("copies").alias("n"))
    worded = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "d1", "d2", "k1")
    linked_rows = spread_join(worded, by_class, ["d1", "d2", "n_shingles"], counts, rows.count(), ["k1"]).select("doc_id", "n_shingles", "component_id")
    result = linked_rows.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_copies(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, any one if none has an id.

    Rows without words link with nothing and all stay. All columns pass unchanged.
    """
    rows, classes = near_classes(docs, plan)
    kept = classes.select("first.k1", "first.k2").distinct()
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return keep_rows(docs, kept, rows, ["doc_id", "text"], also=~worded)


def residual_links(docs: DataFrame, nodes: DataFrame, members: DataFrame, found: DataFrame, plan: Plan) -> DataFrame:
    """Links between components that share a bucket, tested exactly in blocks."""
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    shares = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.sum(F.xxhash64("node", F.lit(1)) % 1_000_003).alias("x2"))
    once = (
        shares.groupBy("key")
        .agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("several"), F.max(F.struct("c", "component")).alias("top"), F.bit_xor("x1").alias("x1"), F.sum("x2").alias("x2"))
        .where("m > 2 and several > 1")  # a bucket of two has been tested
        .groupBy("m", "x1", "x2").agg(F.min(F.struct("key", "top")).alias("b"))  # many bands hold the same members
        .select("b.key", F.col("b.top.component").alias("largest"), "m")
    )
    once = materialise(once, "open")
    total = once.agg(F.sum("m")).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame([], "u long, v long")
    sized = nodes.select("node", "n_shingles", "sig")
    open_members = spread_join(placed.drop("m"), once.select("key", "largest"), ["key"], once.select("key", F.col("m").alias("n")), total, ["node"])
    open_members = materialise(open_members.withColumn("stray", F.col("component") != F.col("largest")).drop("largest"), "strays")
    first = _dealt(open_members.withColumn("weight", F.lit(1)), 1, plan.block_signatures)
    marked = first.join(sized.drop("n_shingles"), "node").groupBy("key", "i", "j").applyInPandas(_block_candidates(plan), "key long, node long")
    marked = materialise(marked.distinct(), "marked")
    chosen = open_members.join(marked, ["key", "node"]).join(sized.select("node", F.col("n_shingles").alias("weight")), "node")
    dealt = materialise(_dealt(chosen, plan.block_shingles, plan.block), "dealt")
    wanted = dealt.select("node").distinct().join(nodes.select("node", "first.k1", "first.k2"), "node")
    sets = full_sets(docs, wanted, plan)
    extra = materialise(dealt.join(sets, "node").groupBy("key", "i", "j").applyInPandas(_block_links(plan), "u long, v long"), "extra")
    discard(once, open_members, marked, dealt)
    return extra


def _dealt(placed: DataFrame, most_weight: int, most_rows: int) -> DataFrame:
    """Rows dealt to blocks (key, i, j): strays to one i and all j, members to one j and all i.

    So every stray meets every member in one block. A block takes about
    ``most_rows`` strays and members (or ``most_weight`` of weight, if that is
    less); a stray of the block's own i stands in it only once.
    """
    parts = lambda rows, weight: F.greatest(F.lit(1), F.ceil(rows / most_rows), F.ceil(weight / most_weight) if most_weight > 1 else F.lit(1)).cast("long")
    stray = F.col("stray")
    sums = placed.groupBy("key").agg(
        parts(F.count(F.lit(1)), F.sum("weight")).alias("js"), parts(F.count_if(stray), F.coalesce(F.sum(F.when(stray, F.col("weight"))), F.lit(0))).alias("is"), F.count(F.lit(1)).alias("n")
    )
    total = placed.count()
    known = spread_join(placed, sums.drop("n"), ["key"], sums.select("key", "n"), total, ["node"])
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    i, j = F.pmod(F.xxhash64("node", F.lit(2)), F.col("is")), F.pmod(F.xxhash64("node", F.lit(3)), F.col("js"))
    as_member = F.transform(upto("is"), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(False).alias("stray")))
    as_stray = F.transform(upto("js"), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(True).alias("stray")))
    places = F.when(stray, F.concat(as_member, as_stray)).otherwise(as_member)
    return known.select("key", "node", "component", F.inline(places))


def op4_near_dedup(spark, sf_dir):
    """Per row of ``documents``, linked at 85 per cent: doc_id, n_shingles, component_id, kept; see ``near_dedup``."""
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), Plan(percent=85))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, p.v FROM r JOIN p ON p.u = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.doc_id
"""
