"""Weighted search of pages by a stated set of queries, which are inverted: pages stream past an automaton of the queries and their words, and each task keeps the best pages of each query.

A page meets only the queries whose text or words stand in it; no page is compared with a query. Queries are cut into blocks of a bounded number of characters, each of which is sent to the tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldwise.functions.scalars import fold
from fieldwise.operators.patterns import automaton, found_patterns
from fieldwise.sources.scratch import cut

#: Characters of the queries of a block, and pairs of queries and pages that a task holds before it drops all but the best.
BLOCK, HELD = 500_000, 1_000_000
#: Points for each article, the page's number, each table head, cell and keyword, the whole query, all of its words, a share of them, and the title.
ARTICLE, NUMBER, HEAD, CELL, KEYWORD, WHOLE, ALL_WORDS, SOME_WORDS, TITLE = 50.0, 40.0, 35.0, 30.0, 20.0, 25.0, 20.0, 10.0, 8.0
#: Words before a page's number, and letters of the shortest word that counts.
NUMBER_WORDS, WORD = ("sayfa ", "page "), 3


class Queries:
    """Folded queries and their words, inverted."""

    def __init__(self, texts: list[str], key: str):
        self.n = len(texts)
        at: dict[str, int] = {}
        owners: list[list[int]] = []
        self.by_text: dict[int, list[int]] = {}
        self.n_words = np.zeros(self.n)
        for i, text in enumerate(texts):
            words = [w for w in text.split(" ") if len(w) >= WORD]
            self.n_words[i] = len(words)
            for w in words:
                if w not in at:
                    at[w] = len(at)
                    owners.append([])
                owners[at[w]].append(i)  # once for each time that the query has the word
            if text not in at:
                at[text] = len(at)
                owners.append([])
            self.by_text.setdefault(at[text], []).append(i)
        self.owners = [np.array(x, np.int64) for x in owners]
        self.machine = automaton(list(at), key)
        # All queries in one string, to find those that hold a name.
        self.joined = "\x00".join(texts) + "\x00"
        self.starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.names: dict[str, np.ndarray] = {}

    def strings_in(self, text: str) -> set[int]:
        return {i for _, (i, _) in self.machine.iter(text)}

    def whole(self, found: set[int]) -> list[int]:
        return [q for i in found if i in self.by_text for q in self.by_text[i]]

    def either(self, name: str) -> np.ndarray:
        """Queries that hold a name or stand in it."""
        known = self.names.get(name)
        if known is None:
            known = np.unique(np.concatenate([self.holding(name), np.array(self.whole(self.strings_in(name)), np.int64)])) if name else np.arange(self.n)
            if len(self.names) > 50_000:
                self.names.clear()
            self.names[name] = known
        return known

    def holding(self, name: str) -> np.ndarray:
        """Queries that hold a name."""
        places, at = [], self.joined.find(name)
        while at >= 0:
            places.append(at)
            at = self.joined.find(name, at + 1)
        return np.searchsorted(self.starts, places, side="right") - 1 if places else np.empty(0, np.int64)

    def scores(self, number: str, text: str, title: str, articles: list[str], headers: list[str], cells: list[str], keywords: list[str]) -> np.ndarray:
        """Points of one page for every query."""
        points, inside = np.zeros(self.n), self.strings_in(text)
        whole = self.whole(inside)
        for name in keywords:
            inside = inside | self.strings_in(name)
        if any(len(self.owners[i]) for i in inside):
            hits = np.bincount(np.concatenate([self.owners[i] for i in inside]), minlength=self.n)
            points = np.where(hits == self.n_words, ALL_WORDS * (self.n_words > 0), SOME_WORDS * hits / np.maximum(self.n_words, 1))
        points[whole] = WHOLE
        for name in articles:
            points[self.either(name)] += ARTICLE
        numbered = np.zeros(self.n, bool)
        for word in NUMBER_WORDS:
            numbered[self.holding(word + number)] = True
        points += NUMBER * numbered
        for names, weight in ((headers, HEAD), (cells, CELL), ([title], TITLE)):
            for name in names:
                np.add.at(points, self.whole(self.strings_in(name)), weight)
        for name in keywords:
            points[self.either(name)] += KEYWORD
        return np.round(points, 6)


def best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query; of equals, the first rows."""
    order = np.lexsort((row, -score, query))
    sorted_query = query[order]
    first = np.searchsorted(sorted_query, sorted_query)
    return order[np.arange(len(order)) - first < k]


def page_search(queries: DataFrame, records: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, page_no, score, rank) by weights: 50 for each article named, 40 for the page's number, 35 and 30 for each table head and cell that holds the query, 20 for each keyword, 25 if the
    text holds the query, else up to 20 by its words, and 8 if the title does. Ties by document and page.

    queries (query_id, text) are a stated set; records are those of ``page_records``, with texts folded once. Null and empty queries find nothing."""
    spark = queries.sparkSession
    folded = lambda c: F.coalesce(F.transform(c, fold), F.array().cast("array<string>"))
    asked = cut(queries.select("query_id", fold(F.col("text")).alias("q")).where("q <> ''"))
    pages = records.select(
        "doc_id", "page_no", F.col("page_no").cast("string").alias("number"), F.coalesce(fold(F.col("text")), F.lit("")).alias("t"), F.coalesce(fold(F.col("title")), F.lit("")).alias("title"),
        folded("articles").alias("articles"), folded("headers").alias("headers"), folded("cells").alias("cells"), folded("keywords").alias("keywords"),
    )
    n_blocks = max(1, -(-(asked.agg(F.sum(F.length("q"))).first()[0] or 0) // BLOCK))
    id_kind = to_arrow_type(asked.schema["query_id"].dataType)
    id_type, kinds = asked.schema["query_id"].dataType.simpleString(), [pages.schema[c].dataType.simpleString() for c in ("doc_id", "page_no")]
    parts = []
    for b in range(n_blocks):
        own = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
        shared = spark.sparkContext.broadcast([(r["query_id"], r["q"]) for r in own.collect()])

        def search(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            if not rows:
                return
            block = Queries([q for _, q in rows], key)
            for batch in batches:
                order = batch.select([0, 1]).to_pandas().sort_values(["doc_id", "page_no"], kind="stable").index
                batch = batch.take(pa.array(order))
                held, n = [], 0
                for row, page in enumerate(zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True)):
                    score = block.scores(*page)
                    found = np.flatnonzero(score > 0)
                    held.append((found, np.full(len(found), row), score[found]))
                    n += len(found)
                    if n > HELD or row == batch.num_rows - 1:
                        query, at, score = (np.concatenate(x) for x in zip(*held, strict=True))
                        kept = best(query, at, score, k)
                        held, n = [(query[kept], at[kept], score[kept])], len(kept)
                if held:
                    query, at, score = held[0]
                    at = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([rows[q][0] for q in query], id_kind), batch.column(0).take(at), batch.column(1).take(at), pa.array(score)], names=["query_id", "doc_id", "page_no", "score"])

        part = pages.mapInArrow(search, f"query_id {id_type}, doc_id {kinds[0]}, page_no {kinds[1]}, score double")
        if n_blocks > 1:
            part = cut(part)
            shared.destroy()
        parts.append(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "page_no"))
    return reduce(DataFrame.union, parts).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "page_no", "score", "rank")


def article_pages(keys: DataFrame, records: DataFrame) -> DataFrame:
    """(key_id, doc_id, page_no) of keys (key_id, text): the first page, by document and number, one of whose articles holds the key or is held by it; else the best page of the search.

    Keys and the distinct names of articles are looked for in each other in one walk over each."""
    names = cut(records.select("doc_id", "page_no", F.explode("articles").alias("a")).groupBy(fold(F.col("a")).alias("a")).agg(F.min(F.struct("doc_id", "page_no")).alias("at")))
    asked = keys.select("key_id", fold(F.col("text")).alias("q")).where("q <> ''")
    in_keys = found_patterns(asked.select(F.col("key_id").alias("text_id"), F.col("q").alias("text")), names.select(F.col("a").alias("pattern"))).select(F.col("text_id").alias("key_id"), F.col("pattern").alias("a"))
    in_names = found_patterns(names.select(F.col("a").alias("text_id"), F.col("a").alias("text")), asked.select(F.col("q").alias("pattern"))).select(F.col("text_id").alias("a"), F.col("pattern").alias("q"))
    hits = in_keys.join(names, "a").select("key_id", "at").union(in_names.join(names, "a").join(asked, "q").select("key_id", "at"))
    found = hits.groupBy("key_id").agg(F.min("at").alias("at")).select("key_id", "at.doc_id", "at.page_no")
    rest = asked.join(found, "key_id", "left_anti").select(F.col("key_id").alias("query_id"), F.col("q").alias("text"))
    return found.unionByName(page_search(rest, records, 1).select(F.col("query_id").alias("key_id"), "doc_id", "page_no"))
