"""A lexical index that is written once, and BM25+ search that opens as little of it as the best scores allow.

The index cuts the corpus into shards of a bounded number of chunks. ``blocks`` has the postings of each token, shard and level of impact (what an occurrence list adds to a score before the
token's weight), with the greatest impact of each block: a common token is many bounded rows and never one group. ``chunks`` has every chunk's shard and the columns to filter by.

A search joins the tokens of the queries with the blocks that have them and hands each shard its blocks and its queries; what leaves a shard are its k best chunks of each query. One shard in
``FIRST`` is searched first: the k-th best score there can only be beaten by the whole corpus, so it bounds what all others have to reach. Within a shard tokens are opened by their greatest shares.
Blocks that can't lift a chunk to the bound with all other tokens' greatest shares are left shut, and once what is left can't lift a new chunk, only those that can still reach it go on, until there are none.
The result is that of scoring every posting.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwise.operators.retrieval import top
from fieldwise.sources.scratch import cut, removed

#: Chunks of a shard (about), levels of impact, one shard of so many that is searched first, and how far sums may differ by their order.
SHARD, LEVELS, FIRST, SLACK = 8_192, 4, 32, 1e-5
BEST = "query_id {id}, chunk_id long, score double, n_opened long"


class SearchIndex(NamedTuple):
    """chunks: chunk_id (long), shard, dl and the columns to filter by; blocks: token, shard, level, most, n, ids, impacts; n_chunks: of the corpus."""

    chunks: DataFrame
    blocks: DataFrame
    n_chunks: int
    n_shards: int


def build_index(chunks: DataFrame, tokens: Column, folder: str, filters: tuple[str, ...] = (), k1: float = 1.5, b: float = 0.75, delta: float = 1.0, shard_size: int | None = None) -> SearchIndex:
    """Write the index of chunks (chunk_id, of a whole number's type, and the columns in ``filters``) to a folder that driver and executors share.

    Texts are dealt by chunk before they are tokenized, so tokens are counted without another shuffle; postings are shuffled once, by token, shard and level."""
    spark = chunks.sparkSession
    n_shards = max(1, -(-chunks.count() // (shard_size or SHARD)))
    shard = F.pmod(F.xxhash64("chunk_id"), F.lit(n_shards)).cast("int").alias("shard")
    keyed = chunks.withColumn("chunk_id", F.col("chunk_id").cast("long")).repartition("chunk_id")
    rows = keyed.select("chunk_id", *filters, tokens.alias("tokens")).select("chunk_id", *filters, F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("token"))
    rows.groupBy("chunk_id", *filters, "dl", "token").agg(F.count(F.lit(1)).cast("int").alias("tf")).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    counts.select("chunk_id", shard, "dl", *filters).distinct().write.parquet(f"{folder}/chunks")
    known = spark.read.parquet(f"{folder}/chunks")
    n_chunks, avgdl = known.agg(F.count(F.lit(1)), F.avg("dl")).first()
    impact = delta + F.col("tf") * (k1 + 1) / (k1 * (1 - b + b * F.col("dl") / (avgdl or 1.0)) + F.col("tf"))
    flat = counts.where("token is not null").select("token", shard, "chunk_id", impact.alias("impact"))
    level = F.least(F.floor((F.col("impact") - delta) / (k1 + 1) * LEVELS), F.lit(LEVELS - 1)).cast("int").alias("level")
    lists = F.sort_array(F.collect_list(F.struct("chunk_id", "impact")))
    blocks = flat.groupBy("token", "shard", level).agg(F.max("impact").alias("most"), F.count(F.lit(1)).alias("n"), lists.alias("p"))
    blocks.select("token", "shard", "level", "most", "n", F.col("p.chunk_id").alias("ids"), F.col("p.impact").alias("impacts")).write.parquet(f"{folder}/blocks")
    removed(spark, f"{folder}/counts")
    return SearchIndex(known, spark.read.parquet(f"{folder}/blocks"), n_chunks, n_shards)


def asked_tokens(queries: DataFrame, index: SearchIndex, tokens: Column) -> DataFrame:
    """(query_id, token, weight): the tokens of the queries that stand in the corpus, and what an impact of theirs counts."""
    asked = queries.select("query_id", F.explode(tokens).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    terms = index.blocks.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("df"))
    return asked.join(terms, "token").select("query_id", "token", (F.col("qtf") * F.log((F.lit(index.n_chunks) + 1) / F.col("df"))).alias("weight"))


def best_of_query(tokens: list[tuple[float, list[tuple[float, np.ndarray, np.ndarray]]]], kept: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best chunks of a shard that reach ``least``, with equals of the k-th, their scores, and the number of postings that were opened.

    tokens: (weight, blocks of (greatest impact, places of chunks, impacts)); kept: whether a chunk may be returned."""
    bounds = [weight * max(b[0] for b in blocks) for weight, blocks in tokens]
    order = sorted(range(len(tokens)), key=lambda i: -bounds[i])
    everything = left = sum(bounds)
    score, alive, n_opened = np.zeros(len(kept)), None, 0
    for turn, i in enumerate(order):
        weight, blocks = tokens[i]
        if alive is None and left < least - SLACK:
            alive = kept & (score + left >= least - SLACK)
        elif alive is not None:
            alive &= score + left >= least - SLACK
        if alive is not None and not alive.any():
            break
        for most, places, impacts in blocks:
            if weight * most + everything - bounds[i] < least - SLACK:
                continue  # no chunk of this block can reach it
            n_opened += len(places)
            if alive is None:
                score[places] += weight * impacts
            else:
                on = alive[places]
                score[places[on]] += weight * impacts[on]
        left -= bounds[i]
        if turn % 8 == 7 and (own := score[kept] if alive is None else score[alive]).size >= k:
            least = max(least, float(np.partition(own, own.size - k)[own.size - k]))
    found = np.flatnonzero((score > 0) & (kept if alive is None else alive))
    if len(found) > k:
        edge = np.partition(score[found], len(found) - k)[len(found) - k]
        found = found[score[found] >= max(edge, least) - SLACK]
    return found, score[found], n_opened


def search_shard(k: int):
    """For a shard's blocks, with its kept chunks as the block without a token, and its rows of queries (query_id, token, weight, least)."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        tokens, most = blocks.column("token").to_pylist(), blocks.column("most").to_pylist()
        lists = [np.asarray(x.values) if x.is_valid else np.empty(0, np.int64) for x in blocks.column("ids")]
        impacts = [np.asarray(x.values) if x.is_valid else None for x in blocks.column("impacts")]
        ids = np.unique(np.concatenate([x for x, t in zip(lists, tokens, strict=True) if t is not None] or [np.empty(0, np.int64)]))
        keeps = [x for x, t in zip(lists, tokens, strict=True) if t is None]
        kept = np.isin(ids, np.concatenate(keeps)) if keeps else np.zeros(len(ids), bool)
        of: dict[str, list] = {}
        for token, m, own, impact in zip(tokens, most, lists, impacts, strict=True):
            if token is not None:
                of.setdefault(token, []).append((m, np.searchsorted(ids, own), impact))
        queries: dict = {}
        for query, token, weight, least in zip(*[asked.column(c).to_pylist() for c in ("query_id", "token", "weight", "least")], strict=True):
            queries.setdefault(query, (least or 0.0, []))[1].append((weight, of[token]))
        out: list[tuple] = []
        for query, (least, own) in queries.items():
            found, score, n = best_of_query(own, kept, k, least)
            out += [(query, int(ids[f]), float(s), n) for f, s in zip(found, score, strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [asked.schema.field("query_id").type, pa.int64(), pa.float64(), pa.int64()]
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("query_id", "chunk_id", "score", "n_opened"), columns, kinds, strict=True)})

    return run


def search_shards(asked: DataFrame, index: SearchIndex, k: int, keep: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, n_opened): the k best chunks of each shard and query that reach the query's bound. asked: (query_id, token, weight, least)."""
    used = index.blocks.join(asked.select("token").distinct(), "token", "left_semi")
    wanted = used.select("shard", "token").distinct().join(asked, "token").select("shard", "query_id", "token", "weight", "least")
    wanted = wanted.toDF(*wanted.columns)  # other columns than the blocks' own
    chunks = index.chunks if keep is None else index.chunks.where(keep)
    allowed = chunks.groupBy("shard").agg(F.collect_list("chunk_id").alias("ids")).select("shard", F.lit(None).cast("string").alias("token"), F.lit(0.0).alias("most"), "ids", F.lit(None).cast("array<double>").alias("impacts"))
    blocks = used.select("shard", "token", "most", "ids", "impacts").unionByName(allowed)
    return blocks.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(search_shard(k), BEST.format(id=asked.schema["query_id"].dataType.simpleString()))


def bm25_search(queries: DataFrame, index: SearchIndex, tokens: Column, k: int = 5, keep: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) by BM25+: chunks that share a token with the query; ``keep``, over the index's filter columns, counts before the cut, frequencies are those of the whole corpus."""
    asked = cut(asked_tokens(queries, index, tokens))
    bounds = asked.select("query_id", F.lit(None).cast("double").alias("least")).limit(0)
    if index.n_shards > FIRST:
        some = (F.col("shard") % FIRST) == 0
        part = index._replace(blocks=index.blocks.where(some), chunks=index.chunks.where(some))
        first = top(search_shards(asked.withColumn("least", F.lit(None).cast("double")), part, k, keep), k)
        bounds = cut(first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")))
    found = search_shards(asked.join(bounds, "query_id", "left"), index, k, keep)
    return top(found.withColumn("score", F.round("score", 6)), k)
