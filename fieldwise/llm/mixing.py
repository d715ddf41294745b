"""Operator 8: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets. The mix takes ``percent`` of all words; sources, in code-point order with null last, have the weights in turn. A
source's target is ``min(cap * size, level * weight)`` for the one level at which the targets have the wanted sum:
what sharing the excess again and again by weight comes to.

Blocks. A source's documents are dealt by hash to blocks, of ``BLOCK_DOCS`` documents or, beyond ``1 << BLOCK_BITS`` blocks, of an equal share of the
source. The blocks stand in a permuted order, and the source's quota is how many of them the target comes to: all of them for each whole copy, then those of
a last, partial turn. The last block of that turn is taken up to the document that comes nearest to the target.

Tree. The quotas of all sources are split in two, again and again, by multivariate-hypergeometric draws, until each shard has its quota of every source's
blocks. A shard then draws the next so many blocks of each source's permuted order, so blocks are disjoint, and is shuffled locally by hash.
What a document is taken for is the sum over the shards that drew its block.

Everything is drawn from hashes and a seed, so reruns agree. Nulls: a null text has no words; a null source is a source of its own, the last; a null
doc_id is an id like others. Rows that are equal in id and text move together. Sources without words give nothing to the mix. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwise.llm.store import if_small, shuffle_partitions, table, written

WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
#: Documents of a block, blocks of a source at most (as bits), and bits of the hash by which words are summed.
BLOCK_DOCS, BLOCK_BITS, RANGE_BITS = 512, 10, 13


def place(seed: int = SEED) -> Column:
    """63 hashed bits of a document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row a source, so windows over all of them are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)))
    rows = rows.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    # At a level, the sources that are full at less are full; the first source at which the level isn't above its own gives the level.
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * (percent / 100)
    rows = rows.withColumn("level_here", (wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    first = F.first(F.when(F.col("level_here") <= F.col("full_at"), F.col("level_here")), ignorenulls=True)
    rows = rows.withColumn("level", first.over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def hypergeometric(total: Column, own: Column, draws: Column, u: Column) -> Column:
    """A draw of how many of ``own`` among ``total`` are in a sample of ``draws``, by inverting the distribution at u in [0, 1).

    Three walks over the possible numbers, each with a running logarithm: the greatest, the sum, and the place of u."""

    def drawn(x: Column) -> Column:
        def step(log: Column, k: Column) -> Column:  # ln p(k) from ln p(k - 1)
            own, draws, total = x["own"], x["draws"], x["total"]
            return log + F.log((own - k + 1).cast("double")) + F.log((draws - k + 1).cast("double")) - F.log(k.cast("double")) - F.log((total - own - draws + k).cast("double"))

        more = F.when(x["hi"] > x["lo"], F.sequence(x["lo"] + 1, x["hi"])).otherwise(F.array().cast("array<long>"))
        zero = F.lit(0.0)
        top = F.aggregate(more, F.struct(zero.alias("l"), zero.alias("top")), lambda a, k: bound(step(a["l"], k), lambda v: F.struct(v.alias("l"), F.greatest(a["top"], v).alias("top"))))["top"]

        def summed(top: Column) -> Column:
            start = F.struct(zero.alias("l"), F.exp(-top).alias("p"))
            norm = F.aggregate(more, start, lambda a, k: bound(step(a["l"], k), lambda v: F.struct(v.alias("l"), (a["p"] + F.exp(v - top)).alias("p"))))["p"]
            return F.struct(top.alias("top"), norm.alias("norm"))

        def picked(s: Column) -> Column:
            start = F.struct(zero.alias("l"), F.exp(-s["top"]).alias("p"), x["lo"].alias("k"))
            step_to = lambda a, k: bound(step(a["l"], k), lambda v: F.struct(v.alias("l"), (a["p"] + F.exp(v - s["top"])).alias("p"), F.when(a["p"] <= x["u"] * s["norm"], k).otherwise(a["k"]).alias("k")))
            return F.aggregate(more, start, step_to)["k"]

        return bound(bound(top, summed), picked)

    of = [c.cast("long").alias(n) for c, n in ((total, "total"), (own, "own"), (draws, "draws"), (F.greatest(F.lit(0), draws + own - total), "lo"), (F.least(own, draws), "hi"))]
    return bound(F.struct(*of, u.alias("u")), drawn)


def quotas(blocks: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """(source, blocks) to (source, shard, first, quota): how many blocks of each source a shard gets, and from which on.

    The tree has one level for each doubling of the shards. A node is a row with the counts of all sources in order; the left half's counts are
    drawn source by source, each among what is left. Nodes of the lower levels are spread over tasks."""
    counts = F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("key"), "source", F.col("blocks").cast("long").alias("n"))))
    nodes = blocks.agg(counts.alias("own")).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(n_shards))
    level = 0
    while n_shards > 1:
        half = F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        total = F.aggregate("own", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        drawn = F.round(total * half / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).cast("long")
        start = F.struct(total.alias("total"), drawn.alias("draws"), F.array().cast("array<long>").alias("got"))

        def step(acc: Column, x: Column) -> Column:
            u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), x["key"], x["source"].isNull()), 11) / F.lit(float(1 << 53))
            return bound(hypergeometric(acc["total"], x["n"], acc["draws"], u), lambda k: F.struct((acc["total"] - x["n"]).alias("total"), (acc["draws"] - k).alias("draws"), F.concat(acc["got"], F.array(k)).alias("got")))

        split = nodes.withColumn("got", F.aggregate("own", start, step)["got"]).withColumn("half", half)
        left = F.transform("own", lambda x, i: F.struct(x["key"].alias("key"), x["source"].alias("source"), F.get("got", i).alias("n")))
        right = F.transform("own", lambda x, i: F.struct(x["key"].alias("key"), x["source"].alias("source"), (x["n"] - F.get("got", i)).alias("n")))
        middle = F.col("lo") + F.col("half")
        both = F.array(F.struct(left.alias("own"), F.col("lo"), middle.alias("hi")), F.struct(right.alias("own"), middle.alias("lo"), F.col("hi")))
        one = F.array(F.struct(F.col("own"), F.col("lo"), F.col("hi")))
        nodes = split.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, both).otherwise(one)).alias("x")).select("x.*")
        n_shards, level = (n_shards + 1) // 2, level + 1
        if level % 3 == 0:
            nodes = written(nodes.repartition(1 << (level - 3), "lo"), "tree")
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode("own").alias("x")).select("shard", "x.source", F.col("x.n").alias("quota"))
    return leaves.withColumn("first", F.sum("quota").over(Window.partitionBy("source").orderBy("shard")) - F.col("quota"))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place) of every document, as a table."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return written(docs.select("doc_id", "source", size.alias("size"), place().alias("place")), "sizes")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def deal(sizes: DataFrame, n_shards: int, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """(source, source_size, target, bits, dealt): one row a source; ``dealt`` has for each of its blocks the copies that shards drew, as (copy, shard, below).

    ``below`` is set on the copy of the block that is taken in part: of it, documents below that place are taken."""
    ranges = sizes.groupBy("source", F.shiftright("place", 63 - RANGE_BITS).alias("r")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    ranges = written(ranges, "ranges")
    sums = ranges.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))
    bits = F.greatest(F.lit(0), F.least(F.lit(BLOCK_BITS), F.ceil(F.log2(F.col("n_docs") / BLOCK_DOCS)))).cast("int")
    goals = targets(sums.select("source", "source_size"), weights, percent, cap).withColumnRenamed("source", "s")
    plan = sums.join(goals.drop("source_size"), same("source", "s")).drop("s").withColumn("bits", bits)
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "plan")

    # Blocks in permuted order; of the last turn, those before the target are whole and the next is the edge.
    own = ranges.join(plan.select(F.col("source").alias("s"), "bits", "rest", "copies", "source_size"), same("source", "s")).drop("s")
    block = F.expr(f"shiftright(r, {RANGE_BITS} - bits)")
    blocks = own.where("source_size > 0").groupBy("source", block.alias("block"), "rest", "copies").agg(F.sum("words").alias("words"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED), "source", "block"), "block")
    blocks = blocks.withColumn("rank", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = written(blocks.withColumn("last_whole", F.col("upto") <= F.col("rest")).withColumn("edge", (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest"))), "blocks")
    edges = blocks.where("edge").select(F.col("source").alias("s"), F.col("block").alias("b"), (F.col("rest") - (F.col("upto") - F.col("words"))).alias("left_over"))

    # The edge block's ranges in order of place, then the documents of the range in which the target lies.
    inside = own.join(edges, same("source", "s") & (block == F.col("b"))).select("source", "r", "words", "left_over")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("r"))
    spot = inside.withColumn("upto", upto).where("upto > left_over and upto - words <= left_over").select(F.col("source").alias("s"), F.col("r").alias("at"), (F.col("left_over") - (F.col("upto") - F.col("words"))).alias("short"))
    spot = written(spot.groupBy("s").agg(F.min("at").alias("at"), F.min_by("short", "at").alias("short")), "spot")
    near = sizes.select("source", "place", "size").join(if_small(spot, spot.count()), same("source", "s") & (F.shiftright("place", 63 - RANGE_BITS) == F.col("at")))
    places = near.groupBy("source", "place", "short").agg(F.sum("size").alias("words"))
    places = places.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("place")))
    # The document that crosses the target is taken if that comes nearer.
    cut = places.groupBy("source").agg(F.max(F.when(F.col("upto") - F.col("words") / 2 <= F.col("short"), F.col("place") + 1)).alias("inner"))
    cut = spot.join(cut, same("source", "s"), "left").select("s", F.coalesce("inner", F.shiftleft("at", 63 - RANGE_BITS)).alias("below"))

    quota = blocks.groupBy("source").agg((F.first("copies") * F.count(F.lit(1)) + F.count_if(F.col("last_whole") | F.col("edge"))).alias("blocks"))
    n_blocks = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n_blocks"))
    shards = quotas(quota, n_shards).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("first", "quota", "shard"))).alias("parts"))
    shards = shards.join(n_blocks.withColumnRenamed("source", "s"), same("source", "s")).drop("s").join(cut, same("source", "s"), "left").drop("s").withColumnRenamed("source", "s")
    drawn = blocks.join(shards, same("source", "s")).drop("s").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(cap))))
    drawn = drawn.withColumn("i", F.col("copy") * F.col("n_blocks") + F.col("rank"))
    drawer = F.get(F.filter("parts", lambda p: (p["first"] <= F.col("i")) & (F.col("i") < p["first"] + p["quota"])), 0)["shard"]
    drawn = drawn.withColumn("shard", drawer).where("shard is not null")
    copies = drawn.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", F.when(F.col("edge") & (F.col("copy") == F.col("copies")), F.col("below")).alias("below")))).alias("c"))
    of_source = copies.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("block", "c"))).alias("dealt")).withColumnRenamed("source", "s")
    return written(plan.join(of_source, same("source", "s"), "left").select("source", "source_size", "target", "bits", "dealt"), "deal")


def drawn_copies(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """Adds to ``rows`` (source, place, ...) their source's row of ``dealt`` and ``drawn``, the copies of each row that shards drew, as (copy, shard).

    A source's row has at most ``cap + 1`` entries for each of its ``1 << BLOCK_BITS`` blocks; the table is broadcast only if all of them are few."""
    by_source = dealt.select(*[F.col(c).alias(f"_mix_{c}") for c in dealt.columns])
    n = dealt.select(F.coalesce(F.sum(F.size("dealt")), F.lit(0))).first()[0]
    joined = rows.join(if_small(by_source, n), same("source", "_mix_source"))
    mine = F.expr("coalesce(try_element_at(_mix_dealt, shiftright(_mix_place, 63 - _mix_bits)), array())")
    return joined.withColumn("_mix_drawn", F.filter(mine, lambda c: c["below"].isNull() | (F.col("_mix_place") < c["below"])))


def shard_count(docs: DataFrame) -> int:
    return max(8, shuffle_partitions(docs.sparkSession))


def mix(docs: DataFrame, n_shards: int | None = None, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, cap: int = 2) -> tuple[DataFrame, DataFrame]:
    """The digest (one row a document) and the mix: (doc_id, copy, shard, turn) for every copy that a shard drew."""
    sizes = measured(docs)
    dealt = deal(sizes, n_shards or shard_count(docs), weights, percent, cap)
    rows = drawn_copies(sizes.withColumn("_mix_place", F.col("place")), dealt)
    digest = rows.select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("size") * F.size("_mix_drawn")).alias("taken"))
    copies = rows.select("doc_id", F.explode("_mix_drawn").alias("c")).select("doc_id", "c.copy", "c.shard")
    return digest, copies.withColumn("turn", F.xxhash64(F.lit(SEED + 1), "copy", "doc_id"))


def mixed(docs: DataFrame, n_shards: int | None = None, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """The documents, with their columns, once for each copy that a shard drew: shard by shard, each shuffled by hash."""
    n = n_shards or shard_count(docs)
    dealt = deal(measured(docs), n, weights, percent, cap)
    rows = drawn_copies(docs.withColumn("_mix_place", place()), dealt)
    rows = rows.select(*[F.col(c) for c in docs.columns], "_mix_place", F.explode("_mix_drawn").alias("_mix_copy"))
    turn = F.xxhash64(F.lit(SEED + 1), "_mix_copy.copy", "_mix_place")
    return rows.withColumn("_mix_turn", turn).repartition(n, F.col("_mix_copy.shard")).sortWithinPartitions("_mix_copy.shard", "_mix_turn").select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0]
