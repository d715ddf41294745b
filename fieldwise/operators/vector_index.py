"""Exact nearest vectors by cosine with pruning: vectors stand in slices around pivots, and the triangle inequality of angles says which slices a query can leave out.

Pivots are some of the vectors, picked by hash. A slice holds vectors of one nearest pivot whose angles to it lie in one narrow band, and is cut further by hash so that its size is bounded. For
a query whose angle to the pivot is known, no vector of the slice can be nearer than the distance between that angle and the band. The likeliest slices are searched first; the k-th best
score there decides which of the others are opened at all. The result is that of comparing every query with every vector."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwise.operators.retrieval import QUERY_BLOCK, top
from fieldwise.sources.scratch import cut

#: Most pivots, width of a band in radians, vectors of a slice (about), slices of a query that are searched first, and how far angles may be off by rounding.
PIVOTS, BAND, SLICE, FIRST, SLACK = 512, 0.05, 2048, 4, 1e-6


class VectorIndex(NamedTuple):
    """vectors: slice, chunk_id (long), unit, the columns to filter by; slices: slice, pivot, lo, hi, n. pivots: the pivots' unit vectors, at most ``PIVOTS``."""

    vectors: DataFrame
    slices: DataFrame
    pivots: np.ndarray


def units(lists: pa.Array) -> np.ndarray:
    """Rows of length 1; of length 0 if a vector has none."""
    flat = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def build_vectors(vectors: DataFrame, folder: str, filters: tuple[str, ...] = (), slice_size: int = SLICE) -> VectorIndex:
    """Write the index of vectors (chunk_id, of a whole number's type, embedding and the columns in ``filters``) to a shared folder. Null embeddings are left out."""
    spark, rows = vectors.sparkSession, vectors.where("embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), *filters, F.col("embedding").cast("array<double>").alias("embedding"))
    n = min(PIVOTS, int(max(1, rows.count()) ** 0.5) + 1)
    picked = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n).collect()
    pivots = units(pa.array([r["embedding"] for r in picked], pa.list_(pa.float64()))) if picked else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = units(batch.column(batch.num_columns - 1))
                apart = angles(unit, shared.value)
                pivot = apart.argmin(axis=1)
                angle = apart[np.arange(len(unit)), pivot]
                pivot[~unit.any(axis=1)] = -1  # vectors of length 0 have no angle
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1]), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(pivot, pa.int32()), pa.array(angle)], names=[*batch.schema.names[:-1], "unit", "pivot", "angle"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    near = rows.mapInArrow(placed, f"{kinds}unit array<double>, pivot int, angle double").withColumn("band", F.floor(F.col("angle") / BAND).cast("int"))
    near.write.parquet(f"{folder}/placed")
    near = spark.read.parquet(f"{folder}/placed")
    # One row for each pivot and band.
    sizes = near.groupBy("pivot", "band").agg(F.count(F.lit(1)).alias("n")).select("pivot", "band", F.ceil(F.col("n") / slice_size).alias("parts"))
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts"))
    near.join(F.broadcast(sizes), ["pivot", "band"]).withColumn("slice", F.concat_ws("/", "pivot", "band", part)).drop("parts", "band").write.parquet(f"{folder}/vectors")
    known = spark.read.parquet(f"{folder}/vectors")
    known.groupBy("slice", "pivot").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/slices")
    return VectorIndex(known.drop("pivot", "angle"), spark.read.parquet(f"{folder}/slices"), pivots)


def least_angles(index: VectorIndex, queries: np.ndarray, slices: pa.RecordBatch) -> np.ndarray:
    """For each slice and query, an angle that no vector of the slice comes below."""
    pivot, lo, hi = (slices.column(c).to_numpy() for c in ("pivot", "lo", "hi"))
    own = angles(index.pivots, queries)[pivot] if len(index.pivots) else np.zeros((len(pivot), len(queries)))
    least = np.maximum(0, np.maximum(own - hi[:, None], lo[:, None] - own))
    least[pivot < 0] = 0
    least[:, ~queries.any(axis=1)] = 0
    return least


def compare(k: int, ids: list, units_of_queries: np.ndarray):
    """For a slice's vectors and the places of its queries: the k best of each query."""

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        place = asked.column("q").to_numpy()
        if not len(vectors) or not len(place):
            return pa.table({"q": pa.array([], pa.int32()), "chunk_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        order = np.argsort(vectors.column("chunk_id").to_numpy(), kind="stable")
        own = vectors.column("chunk_id").to_numpy()[order]
        unit = np.asarray(vectors.column("unit").combine_chunks().flatten()).reshape(len(own), -1)[order]
        score = np.round(units_of_queries[place] @ unit.T, 6)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return pa.table({"q": pa.array(np.repeat(place, best.shape[1]), pa.int32()), "chunk_id": pa.array(own[best.ravel()], pa.int64()), "score": pa.array(np.take_along_axis(score, best, axis=1).ravel())})

    return run


def block_search(spark: SparkSession, ids: list, asked: np.ndarray, index: VectorIndex, k: int, keep: Column | None) -> tuple[DataFrame, DataFrame]:
    """(q, chunk_id, score) and the opened (slice, q) of a block of queries."""
    names = ("slice", "pivot", "lo", "hi", "n")
    slices, vectors = index.slices.select(*names), index.vectors if keep is None else index.vectors.where(keep)
    pivots = VectorIndex(None, None, index.pivots)
    shared = spark.sparkContext.broadcast((pivots, asked))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                least = least_angles(*shared.value, batch)
                some = np.argsort(least, axis=0, kind="stable")[:FIRST]
                q = np.broadcast_to(np.arange(some.shape[1]), some.shape)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some.ravel())), pa.array(q.ravel(), pa.int32()), pa.array(np.take_along_axis(least, some, axis=0).ravel())], names=["slice", "q", "least"])

    def pairs(opened: DataFrame) -> DataFrame:
        own = vectors.join(opened.select("slice").distinct(), "slice", "left_semi").select("slice", "chunk_id", "unit")
        return own.groupBy("slice").cogroup(opened.select(F.col("slice").alias("s"), "q").groupBy("s")).applyInArrow(compare(k, ids, asked), "q int, chunk_id long, score double")

    rank = F.row_number().over(Window.partitionBy("q").orderBy("least", "slice"))
    first = slices.mapInArrow(nearest, "slice string, q int, least double").withColumn("n", rank).where(F.col("n") <= FIRST)
    known = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    # One row for each query of the block.
    reached = {r["q"]: r["score"] for r in pairs(first).withColumn("n", known).where(F.col("n") == k).collect()}
    limit = spark.sparkContext.broadcast(np.array([np.arccos(np.clip(reached[q] - SLACK, -1, 1)) + SLACK if q in reached else np.pi for q in range(len(ids))]))

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, q = np.nonzero(least_angles(*shared.value, batch) <= limit.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(q, pa.int32()), batch.column(4).take(pa.array(row))], names=["slice", "q", "n"])

    opened = slices.mapInArrow(reachable, "slice string, q int, n long")
    return pairs(opened), opened


def search_blocks(queries: DataFrame, index: VectorIndex, k: int, keep: Column | None) -> list[tuple[list, DataFrame, DataFrame]]:
    spark = queries.sparkSession
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = []
    for b in range(n):
        rows = queries.where((F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) & F.col("embedding").isNotNull()).orderBy("query_id").collect()
        if rows:
            ids = [r["query_id"] for r in rows]
            found, opened = block_search(spark, ids, units(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))), index, k, keep)
            blocks.append((ids, cut(found) if n > 1 else found, opened))
    return blocks


def nearest_vectors(queries: DataFrame, index: VectorIndex, k: int = 5, keep: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine, exact; ``keep``, over the index's filter columns, counts before the cut. queries (query_id, embedding) are a stated set and go through the driver in blocks."""
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    parts = []
    for ids, found, _ in search_blocks(queries, index, k, keep):
        names = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {kind}")
        parts.append(found.join(F.broadcast(names), "q").select("query_id", "chunk_id", "score"))  # one row for each query of a block
    if not parts:
        parts = [queries.select("query_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)]
    return top(reduce(DataFrame.union, parts), k)


def scanned_share(queries: DataFrame, index: VectorIndex, k: int = 5, keep: Column | None = None) -> float:
    """Share of all pairs of queries and vectors that a search compares, besides those of the first slices."""
    blocks = search_blocks(queries, index, k, keep)
    compared = sum(opened.agg(F.sum("n")).first()[0] or 0 for _, _, opened in blocks)
    n = (index.slices.agg(F.sum("n")).first()[0] or 0) * sum(len(ids) for ids, _, _ in blocks)
    return compared / n if n else 0.0
