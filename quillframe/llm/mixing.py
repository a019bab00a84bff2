"""Mixing sources to target weights by pivotal dependent rounding.

A document of ``size`` words in a source whose target is ``rate`` times its
size is due ``rate`` copies: the whole part for certain, the fraction as a
probability. Pivotal rounding settles the fractions: two units meet and
probability mass moves between them, in the direction that a hashed draw
chooses, until one of the two is 0 or 1; the other goes on with what is left.
Mass is counted in words (a unit's probability times its size), so every
transfer keeps the source's expected words exactly, and each unit keeps its
own expectation.

The meetings form a reduction tree. At each level the open units of a source
are dealt by hash into groups of about ``fan_in``; a fold inside one JVM
expression settles all units of the group but one, and that residual goes to
the next level. A hot source is just more groups, dealt over all tasks. After
ceil(log_fan_in(units)) levels one residual a source is left and is rounded by
its own draw, so a source's words miss its target by less than one document.

Draws depend on a unit's document (id, source, text) and on its number among
the rows that repeat it, so that reruns agree and copies do not crowd into one
group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import free_names, materialise, numbered, occurrence, row_key, spread_join, table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of maximal runs of characters that are no ASCII white space; null has 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def source_key(source: Column) -> Column:
    """A text that is never null and differs for every source and null."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def source_targets(sized: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """(skey, source, source_size, docs, target) of every source, null source included.

    Sources in code point order, null last, weigh 1, 2, .., ``cycle`` and again.
    Targets share all words by weight; a source above ``cap`` times its size
    stops there and the excess is shared by weight among the others, until none
    is above. Each pass is one aggregate over one row a source; three numbers
    come back from it.
    """
    sources = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = numbered(sources.orderBy(F.col("source").asc_nulls_last()), "place", 0)
    limit, weight = F.col("source_size") * cap, F.pmod("place", F.lit(cycle)) + 1
    ranked = materialise(ranked.select("skey", "source", "source_size", "docs", limit.alias("limit"), weight.cast("double").alias("weight")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while total:
        over = F.col("limit") < F.col("weight") * level
        used, free, n = ranked.agg(F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == stopped or not free:
            break
        level, stopped = (total - (used or 0.0)) / free, n
    return ranked.select("skey", "source", "source_size", "docs", F.least(F.col("limit"), F.col("weight") * level).alias("target"))


def uniform(*parts):
    """A draw from [0, 1) that the parts determine."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


UNIT = ("u", "doc_id", "k1", "k2", "occ", "size", "copies")


def _fold(units, seed: int, level):
    """Settle all units of a sorted array but one.

    A unit is ``UNIT`` and p; the result is (open unit, settled units). The
    open unit starts as the first of the array.
    """

    def meet(acc, b):
        a = acc["open"]
        ma, mb = a["p"] * a["size"], b["p"] * b["size"]
        room_a, room_b = (1 - a["p"]) * a["size"], (1 - b["p"]) * b["size"]
        up = F.least(room_a, mb)  # words that can move from b to a
        down = F.least(ma, room_b)  # and from a to b
        to_a = uniform(a["u"], b["u"], F.lit(seed), level) * (up + down) < down
        # whichever unit the transfer exhausts or fills is settled; the other one stays open
        a_done = F.when(to_a, room_a <= mb).otherwise(ma <= room_b)
        move = F.when(to_a, up).otherwise(-down)
        pa = F.when(a_done, F.when(to_a, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ma + move) / a["size"])))
        pb = F.when(a_done, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mb - move) / b["size"]))).otherwise(F.when(to_a, 0.0).otherwise(1.0))
        unit = lambda x, p: F.struct(*[x[c].alias(c) for c in UNIT], p.alias("p"))
        na, nb = unit(a, pa), unit(b, pb)
        return F.struct(F.when(a_done, nb).otherwise(na).alias("open"), F.array_append(acc["done"], F.when(a_done, na).otherwise(nb)).alias("done"))

    start = F.struct(units[0].alias("open"), F.slice(units, 1, 0).alias("done"))
    return F.aggregate(F.slice(units, 2, F.size(units)), start, meet)


def pivotal_round(open_units: DataFrame, seed: int, fan_in: int = 48) -> DataFrame:
    """Settle (skey, *UNIT, p) units, u distinct within a source; the result has p 0 or 1 everywhere.

    Rows come back as they went in but for ``p``. Each level is written as a
    table before the next starts.
    """
    most = open_units.groupBy("skey").count().agg(F.max("count")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most, 2), fan_in)))
    settled = None
    for level in range(levels):
        sizes = open_units.groupBy("skey").agg(F.count(F.lit(1)).alias("n"))
        groups = F.lit(1).cast("long") if level == levels - 1 else F.ceil(F.col("n") / fan_in)
        unit = F.struct(*UNIT, "p")
        grouped = (
            spread_join(open_units, sizes.select("skey", groups.alias("groups")), ["skey"], sizes, open_units.count(), ["u"])
            .groupBy("skey", F.pmod(F.xxhash64("u", F.lit(seed), F.lit(level)), "groups").alias("g"))
            .agg(F.sort_array(F.collect_list(unit)).alias("units"))
            .select("skey", _fold(F.col("units"), seed, F.lit(level)).alias("r"))
        )
        grouped = materialise(grouped, f"pivotal-{level}")
        done = grouped.select("skey", F.explode("r.done").alias("x")).select("skey", "x.*")
        settled = done if settled is None else settled.unionByName(done)
        open_units = grouped.select("skey", "r.open.*")
    last = F.when(uniform(F.col("u"), F.lit(seed), F.lit(-1)) < F.col("p"), 1.0).otherwise(0.0)
    return settled.unionByName(open_units.withColumn("p", last))


def mixed_units(docs: DataFrame, seed: int, cap: float, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(skey, doc_id, k1, k2, occ, size, copies) of all rows, and the sources' targets."""
    k1, k2 = row_key(F.col("doc_id"), F.col("source"), F.col("text"))
    size = word_count(F.col("text")).cast("long")
    sized = materialise(docs.select("doc_id", "source", source_key(F.col("source")).alias("skey"), size.alias("size"), k1.alias("k1"), k2.alias("k2")), "sizes")
    repeated = sized.groupBy("k1", "k2").count().where("count > 1")
    units = sized.withColumn("occ", F.lit(0).cast("long"))
    if not repeated.isEmpty():
        alone = units.join(repeated, ["k1", "k2"], "left_anti")
        units = materialise(alone.unionByName(occurrence(sized.join(repeated, ["k1", "k2"], "left_semi"), ["k1", "k2"], "occ").withColumn("occ", F.col("occ").cast("long"))), "units")
    targets = materialise(source_targets(sized, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    rates = targets.select("skey", rate.alias("rate"))
    due = spread_join(units, rates, ["skey"], targets.select("skey", F.col("docs").alias("n")), units.count(), ["k1"])
    due = due.withColumn("copies", F.floor("rate")).withColumn("p", F.col("rate") - F.col("copies"))
    is_open = (F.col("p") > 0) & (F.col("size") > 0)
    u = F.xxhash64("k1", "k2", "occ", F.lit(seed))
    rounded = pivotal_round(due.where(is_open).withColumn("u", u).select("skey", *UNIT, "p"), seed, fan_in)
    whole = due.where(~is_open).withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.least(F.col("copies"), F.lit(1)))).withColumn("p", F.lit(0.0))
    names = ("skey", "doc_id", "k1", "k2", "occ", "size")
    every = rounded.select(*names, "copies", "p").unionByName(whole.select(*names, "copies", "p"))
    return every.select(*names, (F.col("copies") + F.col("p")).cast("long").alias("copies")), targets


def mix_sources(docs: DataFrame, seed: int = 7, cap: float = 3.0, fan_in: int = 48) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    ``size`` counts words of whole texts (null text: 0), ``copies`` says how
    often the mix takes the document and ``taken`` is ``copies * size``.
    Documents of size 0 are taken once each if their source's rate is 1 or
    more, else never; they do not move any words. A null source is a source of
    its own, last in order. Repeated rows are units of their own, numbered, so
    the result is the same multiset on every run. An empty table gives an empty
    result; where all texts are empty every target is 0. Other columns are
    ignored, whatever their names.
    """
    units, targets = mixed_units(docs, seed, cap, fan_in)
    known = targets.select("skey", "source", "source_size", "target")
    joined = spread_join(units, known, ["skey"], targets.select("skey", F.col("docs").alias("n")), targets.agg(F.sum("docs")).first()[0] or 0, ["k1", "occ"])
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame, seed: int = 7, cap: float = 3.0, fan_in: int = 48) -> DataFrame:
    """``docs`` with every row as often as ``mix_sources`` takes it.

    Rows are matched to their copies by id, source, text and number among equal
    ones, so rows without an id, rows that share one and repeated rows all get
    their own. All columns pass unchanged.
    """
    units, _ = mixed_units(docs, seed, cap, fan_in)
    units = materialise(units.select("k1", "k2", "occ", "copies"), "copies")
    a, b, occ, copies, copy = free_names(docs, "__k1", "__k2", "__occ", "__copies", "__copy")
    keyed = docs.withColumns(dict(zip((a, b), row_key(docs["doc_id"], docs["source"], docs["text"]))))
    many = materialise(units.where("occ > 0").select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct(), "repeated")
    chosen = units.where("copies > 0").select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("occ").cast("long").alias(occ), F.col("copies").alias(copies)).hint("shuffle_hash")
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    if many.isEmpty():
        taken = keyed.join(chosen.drop(occ), [a, b])
    else:
        alone = keyed.join(many, [a, b], "left_anti").withColumn(occ, F.lit(0).cast("long"))
        again = occurrence(keyed.join(many, [a, b], "left_semi"), [a, b], occ).withColumn(occ, F.col(occ).cast("long"))
        taken = alone.unionByName(again).join(chosen, [a, b, occ])
    return taken.withColumn(copy, repeat).select(*[taken[c] for c in docs.columns])


def op2_mix_sources(spark, sf_dir):
    """Per row of ``documents``: doc_id, size, source_size, target, taken, source, copies; see ``mix_sources``."""
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
