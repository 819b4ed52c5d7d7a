"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame functions only.

Every source is dealt into blocks by a hash of its rows, so that the order of its blocks is a random permutation. How
many blocks each source gives (its quota) follows from its target. The tree then splits the quotas of all sources
between two halves of the output shards, again and again, by hypergeometric draws: the shards' numbers of blocks are
those of a random deal, and they sum up exactly. Shards take disjoint runs of each source's permuted blocks, and rows are
shuffled within their shard.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.llm.common import word_count, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Blocks of a source: about one for each BLOCK_WORDS words, at most BLOCKS. A draw misses by half of the smallest block
#: that it leaves out at most.
BLOCK_WORDS, BLOCKS = 64, 4096
SHARDS = 16
#: Rows of the corpus for each of the parts that a shard is written in; a shard has 64 at least.
TASK_ROWS = 100_000
SEED = 20


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """``source, source_size`` with ``place`` (code point order, null last), ``weight`` and ``target``.

    Targets share the summed size by weight. None exceeds ``most_repeats`` times its source's size; the excess is shared
    among the others by weight. Sources enter in the order of the level at which they are capped: each is capped if its cap
    is below its share of what the sources capped before it leave. The window is over sources, not rows.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    placed = sources.withColumn("place", order).withColumn("weight", cycle[F.col("place") % len(weights)])
    limit = F.col("source_size") * F.lit(float(most_repeats))
    by_level = Window.orderBy(limit / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    share = placed.withColumns({
        "_limit": limit, "_left": left, "_weights": weight_left, "_level": -F.row_number().over(by_level)})
    capped = F.col("_limit") <= F.col("_left") * F.col("weight") / F.col("_weights")
    # the uncapped sources all share what the last capped one leaves
    free = F.max(F.when(~capped, F.struct("_level", "_left", "_weights"))).over(everything)
    level = share.withColumns({"_capped": capped, "_free": free})
    return level.select(
        "source", "source_size", "place", "weight",
        F.when(F.col("_capped"), F.col("_limit"))
        .otherwise(F.col("_free._left") * F.col("weight") / F.col("_free._weights")).cast("double").alias("target"),
    )


def hypergeometric(total: Column, good: Column, draws: Column, uniform: Column) -> Column:
    """A hypergeometric draw by inversion: the number of ``good`` among ``draws`` of ``total``.

    The probabilities follow from the mode's by their ratios, to twelve standard deviations on both sides.
    """
    low = F.greatest(F.lit(0).cast("long"), draws + good - total)
    high = F.least(draws, good)
    mode = F.least(high, F.greatest(low, F.floor((draws + 1) * (good + 1) / (total + 2))))
    spread = F.sqrt(draws * good / total * (1 - good / total) * (total - draws) / F.greatest(total - 1, F.lit(1)))
    reach = F.ceil(spread * 12) + 12
    above, below = F.least(high, mode + reach), F.greatest(low, mode - reach)

    def climb(k):  # p(k) / p(k - 1)
        return (good - k + 1).cast("double") * (draws - k + 1) / (k * (total - good - draws + k))

    def descend(k):  # p(k) / p(k + 1)
        return (k + 1).cast("double") * (total - good - draws + k + 1) / ((good - k) * (draws - k))

    upper = F.when(above > mode, F.sequence(mode + 1, above)).otherwise(F.array().cast("array<bigint>"))
    lower = F.when(below < mode, F.sequence(mode - 1, below, F.lit(-1))).otherwise(F.array().cast("array<bigint>"))

    def mass(steps, ratio):
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        return F.aggregate(steps, start, lambda a, k: F.struct(
            (a["p"] * ratio(k)).alias("p"), (a["sum"] + a["p"] * ratio(k)).alias("sum")), lambda a: a["sum"])

    def find(steps, ratio, rest):
        start = F.struct(F.lit(1.0).alias("p"), rest.alias("rest"), mode.alias("k"))
        return F.aggregate(steps, start, lambda a, k: F.struct(
            (a["p"] * ratio(k)).alias("p"), (a["rest"] - a["p"] * ratio(k)).alias("rest"),
            F.when(a["rest"] > 0, k).otherwise(a["k"]).alias("k")), lambda a: F.struct(a["k"], a["rest"]))

    # the mass of the mode is 1; what a uniform share of the whole mass leaves beyond it goes up, then down
    rest = uniform * (1 + mass(upper, climb) + mass(lower, descend)) - 1
    up = find(upper, climb, rest)
    return F.when(total <= 0, F.lit(0).cast("long")).when(rest <= 0, mode).when(up["rest"] <= 0, up["k"]).otherwise(
        find(lower, descend, up["rest"])["k"])


def split_node(quotas: Column, draws: Column, salt: Column) -> Column:
    """How many blocks of each source the left half of a node gets: one hypergeometric draw after another."""
    start = F.struct(
        F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q).alias("total"), draws.cast("long").alias("draws"),
        F.array().cast("array<bigint>").alias("out"))

    def step(a, q):
        uniform = F.pmod(F.xxhash64(salt, F.size(a["out"])), F.lit(1 << 52)) / F.lit(float(1 << 52))
        # the draw is bound to a name by a list of one, so that it is made once
        return F.transform(F.array(hypergeometric(a["total"], q, a["draws"], uniform)), lambda x: F.struct(
            (a["total"] - q).alias("total"), (a["draws"] - x).alias("draws"),
            F.concat(a["out"], F.array(x)).alias("out")))[0]

    return F.aggregate(quotas, start, step, lambda a: a["out"])


def shard_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """``place, ends``: the summed quotas of a source up to each shard, from ``place, quota`` (long) of every source.

    One row holds a long per source; sources are labels, thousands at most. ``shards`` is a power of 2.
    """
    node = sources.agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "quota"))), lambda s: s["quota"]).alias("quotas"),
    ).withColumn("node", F.lit(1))
    for level in range(shards.bit_length() - 1):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        left = split_node(F.col("quotas"), F.floor(total / 2), F.xxhash64(F.lit(seed), F.lit(level), "node"))
        halves = node.withColumn("_left", left).select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("_left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"),
                     F.zip_with("quotas", "_left", lambda q, x: q - x).alias("quotas")))).alias("half"))
        node = halves.select("half.quotas", "half.node")
    each = node.select("node", F.posexplode("quotas").alias("place", "quota"))
    upto = Window.partitionBy("place").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("end", F.sum("quota").over(upto)).groupBy("place").agg(
        F.sort_array(F.collect_list(F.col("end"))).alias("ends"))


@dataclass
class Plan:
    """``sources``: source, place, blocks (how many), source_size, target. ``taken``: place, block and the shards that its
    copies go to."""

    sources: DataFrame
    taken: DataFrame
    seed: int

    def joined(self, rows: DataFrame, doc_id: str, source: str) -> DataFrame:
        """The rows with ``place, block, source_size, target, shards``."""
        named = self.sources.select(F.col("source").alias("_source"), "place", "blocks", "source_size", "target")
        return rows.join(named, F.col(source).eqNullSafe(F.col("_source"))).withColumn(
            "block", block_of(self.seed, source, doc_id)).drop("_source", "blocks").join(self.taken, ["place", "block"])


def block_of(seed: int, source: str, doc_id: str):
    return F.pmod(F.xxhash64(F.lit(seed), source, doc_id), "blocks")


def plan_of(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS, shards: int = SHARDS, seed: int = SEED,
) -> Plan:
    """What the mix takes of ``rows`` (``doc_id, source, size``).

    Whole passes over a source are taken as often as they fit into its target, then each permuted block that fits into what
    is left, then one more block if that brings the sum nearer to the target.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = written(
        targets(sources, weights, most_repeats).withColumn(
            "blocks", F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS)))).withColumn(
            "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)),
        "targets")
    named = planned.select(F.col("source").alias("_source"), "place", "blocks")
    sizes = (
        rows.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .groupBy("place", block_of(seed, "source", "doc_id").alias("block")).agg(F.sum("size").alias("words"))
    )
    numbered = written(drawn_blocks(sizes, planned.select("place", "source_size", "target", "passes")), "blocks")
    quotas = numbered.groupBy("place").agg(F.sum(F.col("passes") + F.col("drawn").cast("long")).cast("long").alias("quota"))
    none = F.array().cast("array<bigint>")
    whole = F.when(F.col("passes") > 0, F.transform(
        F.sequence(F.lit(0), F.col("passes").cast("int") - 1),
        lambda e: (e * F.col("held") + F.col("position")).cast("long"))).otherwise(none)
    partial = F.when(
        F.col("drawn"), F.array((F.col("passes") * F.col("held") + F.col("extra")).cast("long"))).otherwise(none)
    # the i-th block drawn from a source goes to the shard whose run of the source's quota holds i
    taken = numbered.join(shard_quotas(quotas, shards, seed), "place").select("place", "block", F.transform(
        F.concat(whole, partial), lambda i: F.size(F.filter("ends", lambda end: end <= i))).alias("shards"))
    return Plan(planned, written(taken, "taken_blocks"), seed)


def filled(blocks: Column, rest: Column) -> Column:
    """``gap, taken, left``: block by block, one that fits into what is left of ``rest`` is taken, another one is left out."""
    none = F.array().cast("array<struct<block:bigint,words:bigint>>")

    def turn(s, b):
        fits = (b["words"] <= s["gap"]) & (s["gap"] > 0)
        return F.when(fits, F.struct(
            (s["gap"] - b["words"]).alias("gap"), F.concat(s["taken"], F.array(b)).alias("taken"), s["left"].alias("left"))).otherwise(
            F.struct(s["gap"].alias("gap"), s["taken"].alias("taken"), F.concat(s["left"], F.array(b)).alias("left")))

    return F.aggregate(blocks, F.struct(rest.cast("double").alias("gap"), none.alias("taken"), none.alias("left")), turn)


def closed(draw: Column) -> Column:
    """``miss, chosen``: the taken blocks, and the smallest one left out if the sum is nearer to the target with it."""
    least = F.array_min(F.transform(draw["left"], lambda b: F.struct(b["words"].alias("words"), b["block"].alias("block"))))
    chosen = F.transform(draw["taken"], lambda b: b["block"])
    over = least["words"] - draw["gap"]
    return F.when(over < draw["gap"], F.struct(
        over.alias("miss"), F.concat(chosen, F.array(least["block"])).alias("chosen"))).otherwise(
        F.struct(draw["gap"].alias("miss"), chosen.alias("chosen")))


def drawn_blocks(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``place, block, passes, drawn, position, extra, held``: whether a block is drawn beyond the whole passes, its position
    among its source's ``held`` blocks, and how many blocks before it are drawn.

    A source is one row with at most BLOCKS blocks. Where all that fits is less than the rest, because a very large block
    came too late, the blocks left out take the first turns; the draw that comes nearer counts.
    """
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    pair = F.struct(F.col("block").cast("long").alias("block"), F.col("words").cast("long").alias("words"))
    first = written(
        sizes.groupBy("place").agg(F.sort_array(F.collect_list(pair)).alias("blocks")).join(plan, "place").select(
            "place", "passes", "blocks", rest.alias("rest")).withColumn("draw", filled(F.col("blocks"), F.col("rest"))), "draws")
    second = filled(F.concat("draw.left", "draw.taken"), F.col("rest"))
    both = F.array(closed(F.col("draw")), F.transform(F.array(second), closed)[0])
    chosen = F.transform(F.array(both), lambda d: F.when(d[1]["miss"] < d[0]["miss"], d[1]["chosen"]).otherwise(d[0]["chosen"]))[0]
    drawn = written(first.select("place", "passes", "blocks", chosen.alias("chosen")), "chosen_blocks").select(
        "place", "passes", F.explode(F.transform("blocks", lambda b: F.struct(
            b["block"].alias("block"), F.array_contains("chosen", b["block"]).alias("drawn")))).alias("b")).select(
        "place", "b.block", "passes", "b.drawn")
    per_source, upto = Window.partitionBy("place"), Window.partitionBy("place").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumns({
        "position": F.row_number().over(upto) - 1,
        "extra": F.coalesce(F.sum(F.col("drawn").cast("long")).over(before), F.lit(0)),
        "held": F.count(F.lit(1)).over(per_source),
    }).select("place", "block", "passes", "drawn", "position", "extra", "held")


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return written(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")), "sizes")


def assigned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size`` (words), ``source_size, target, taken`` (words that the mix takes,
    repeats counted) and ``shards`` (one entry per copy that the mix holds).

    A null text has size 0; a null source is a source of its own; an empty table gives no rows. Repeated rows with one
    doc_id lie in one block. Same rows and seed give the same mix.
    """
    rows = sized(docs, doc_id, text, source)
    return plan_of(rows, **options).joined(rows, "doc_id", "source").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: each as often as the mix takes it, dealt out by shard and shuffled
    within. Rows of blocks that aren't drawn are left out."""
    sizes = sized(docs, doc_id, text, source)
    plan = plan_of(sizes, **options)
    spread = max(64, math.ceil(sizes.count() / TASK_ROWS))
    keys = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), F.col(source).alias("_from"))
    copies = plan.joined(keys, "_id", "_from").select("_row", "_id", F.posexplode("shards").alias("_copy", "_shard"))
    order = F.xxhash64(F.lit(plan.seed), "_id", "_copy")
    return copies.withColumn("_order", order).repartition("_shard", F.pmod("_order", F.lit(spread))).sortWithinPartitions(
        "_shard", "_order").select("_row.*")
