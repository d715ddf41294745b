"""Search and patterns against plain versions."""

import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from fieldwise.functions import scalars as S
from fieldwise.operators import lookups, page_search, patterns, retrieval, search_index, vector_index
from fieldwise.sources.scratch import folder


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("chunk_id"), "source", "lang", "text")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return chunks, queries, S.tokens(F.col("text"))


@pytest.mark.parametrize("keep", [None, "lang <> 'en'", "source = 'no such'"])
def test_search_equals_scoring_everything(spark, corpus, keep, monkeypatch):
    """In many shards, of which a few are searched first, so that bounds, shut blocks and shards without a hit all occur."""
    chunks, queries, words = corpus
    monkeypatch.setattr(search_index, "FIRST", 4)
    index = search_index.build_index(chunks, words, folder(spark, "index"), ("source", "lang"), shard_size=10)
    assert index.n_shards > 8
    wanted = None if keep is None else F.expr(keep)
    got = search_index.bm25_search(queries, index, words, 5, wanted).collect()
    want = retrieval.bm25_top(queries, chunks, words, words, 5, keep=wanted).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and (want or keep == "source = 'no such'")


def test_search_of_nothing(spark, corpus):
    chunks, queries, words = corpus
    index = search_index.build_index(chunks.limit(0), words, folder(spark, "index"), ("source",))
    assert search_index.bm25_search(queries, index, words).count() == 0
    some = spark.createDataFrame([(1, "aa bb"), (2, ""), (3, "aa")], "chunk_id int, text string")
    index = search_index.build_index(some, words, folder(spark, "index"))
    asked = spark.createDataFrame([("x", "aa"), ("y", "zz"), ("z", "")], "query_id string, text string")
    assert [(r.query_id, r.chunk_id) for r in search_index.bm25_search(asked, index, words).orderBy("rank").collect()] == [("x", 3), ("x", 1)]


def test_best_of_one_shard():
    """The best chunks are those of a full search, and a bound that nothing reaches leaves all postings shut."""
    r = np.random.default_rng(3)
    for turn in range(40):
        n, tokens = 2000, []
        for df in (5, 20, 60, 300, 900, 1500):
            own, weight = np.sort(r.choice(n, df, replace=False)), float(np.log((n + 1) / df))
            impacts = 1 + 2.5 * r.random(df)
            cuts = np.digitize(impacts, [1.6, 2.3, 2.9])
            tokens.append((weight, [(float(impacts[cuts == c].max()), own[cuts == c], impacts[cuts == c]) for c in range(4) if (cuts == c).any()]))
        score = np.zeros(n)
        for weight, blocks in tokens:
            for _, places, impacts in blocks:
                score[places] += weight * impacts
        kept = r.random(n) < (1.0 if turn % 2 else 0.3)
        best = np.sort(score[kept & (score > 0)])[::-1][:5]
        found, got, opened = search_index.best_of_query(tokens, kept, 5, float(best[-1]) * (turn % 4 > 1))
        assert np.allclose(np.sort(got)[::-1][:5], best) and kept[found].all() and np.allclose(score[found], got)
        assert opened <= sum(len(p) for _, b in tokens for _, p, _ in b) and search_index.best_of_query(tokens, kept, 5, 1e9)[2] == 0


def test_patterns_against_brute_force(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abcç ") for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, ""]
    # Strings inside, after and across each other, and repeated ones.
    strings = ["a", "aa", "aaa", "ab", "b", "abab", "bab", "ç", "a ç", " ", "", None, "ab", "zz", *{t[3:9] for t in texts[:50] if t}]
    docs = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string").repartition(3)
    names = spark.createDataFrame([(s,) for s in strings], "pattern string")
    want = sorted((i, p, t.count(p)) for i, t in enumerate(texts) if t for p in {s for s in strings if s} if p in t)
    assert sorted(map(tuple, patterns.found_patterns(docs, names).collect())) == want
    assert sorted(map(tuple, patterns.found_patterns(docs, names, block=40).collect())) == want
    assert patterns.found_patterns(docs, names.limit(0)).count() == 0 == patterns.found_patterns(docs.limit(0), names).count()


def test_first_containment_against_brute_force(spark):
    r = random.Random(6)
    crops = ["".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in range(150)]
    names = [(i, "".join(r.choice("abc") for _ in range(r.randint(2, 6))), f"C{i}") for i in range(12)]
    rows = spark.createDataFrame(list(enumerate(crops)), "id int, crop string")
    got = {x["id"]: x["code"] for x in lookups.by_first_containment(rows, "crop", spark.createDataFrame(names, "ordinal int, name string, code string")).collect()}
    assert got == {i: next((c for _, n, c in names if t and (t in n or n in t)), None) for i, t in enumerate(crops)}


def test_page_search_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    some = lambda n: " ".join("".join(r.choice("abç") for _ in range(r.randint(1, 4))) for _ in range(n))
    records = [(r.randint(0, 6), i, some(8) if i % 9 else None, some(2), [f"madde {r.randint(1, 12)}"] * (i % 3 > 0), [some(2)] * (i % 2), [some(3), some(1)], [some(1)] if i % 5 else []) for i in range(150)]
    queries = [(i, [some(1), some(3), f"madde {i % 12} {some(2)}", f"sayfa {i} {some(1)}", "", None][i % 6]) for i in range(60)]

    def points(q, page):
        _, no, text, title, articles, heads, cells, keywords = page
        text, words = text or "", [w for w in q.split(" ") if len(w) >= 3]
        hits = sum(w in text or any(w in x for x in keywords) for w in words)
        score = 25 if q in text else 0 if not words else 20 if hits == len(words) else 10 * hits / len(words)
        score += 50 * sum(a in q or q in a for a in articles) + 40 * (f"sayfa {no}" in q or f"page {no}" in q) + 35 * sum(q in x for x in heads) + 30 * sum(q in x for x in cells)
        return round(score + 20 * sum(x in q or q in x for x in keywords) + 8 * (q in title), 6)

    want = []
    for i, q in queries:
        if q:
            found = sorted((-points(q, p), p[0], p[1]) for p in records if points(q, p) > 0)[:4]
            want += [(i, doc, no, -s, n + 1) for n, (s, doc, no) in enumerate(found)]
    pages = spark.createDataFrame(records, "doc_id int, page_no int, text string, title string, articles array<string>, headers array<string>, cells array<string>, keywords array<string>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id int, text string")
    for block, held in ((10**6, 10**6), (150, 50)):
        monkeypatch.setattr(page_search, "BLOCK", block)
        monkeypatch.setattr(page_search, "HELD", held)
        got = page_search.page_search(asked, pages, 4)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    keys = spark.createDataFrame([(1, "madde 3 x"), (2, "adde 1"), (3, "yok"), (4, None)], "key_id int, text string")
    at = {i: min(((p[0], p[1]) for p in records if any(f(a) for a in p[4])), default=None) for i, f in ((1, lambda a: a in "madde 3 x"), (2, lambda a: "adde 1" in a))}
    got = {x.key_id: (x.doc_id, x.page_no) for x in page_search.article_pages(keys, pages).collect()}
    assert got[1] == at[1] and got[2] == at[2] and 4 not in got


@pytest.mark.parametrize("keep", [None, "label = 1"])
def test_nearest_vectors_against_brute_force(spark, keep, monkeypatch):
    """Clustered vectors in many small slices, with equal vectors, one of length 0 and null ones; several blocks of queries."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 6))
    vectors = np.vstack([centres[i % 12] + 0.05 * r.normal(size=6) for i in range(600)] + [np.zeros(6), *[centres[0]] * 8])
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)] + [(9000, None, 1)]
    table = spark.createDataFrame(rows, "chunk_id int, embedding array<double>, label int")
    queries = table.where("chunk_id % 7 = 0 or chunk_id = 600").select(F.concat(F.lit("q"), F.col("chunk_id").cast("string")).alias("query_id"), "embedding")
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 40)
    index = vector_index.build_vectors(table, folder(spark, "vectors"), ("label",), slice_size=20)
    got = sorted(map(tuple, vector_index.nearest_vectors(queries, index, 4, None if keep is None else F.expr(keep)).collect()))
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    want = []
    for q in [i for i in range(len(vectors)) if i % 7 == 0 or i == 600]:
        score = np.round(unit[q] @ unit.T, 6)
        own = [i for i in range(len(vectors)) if keep is None or i % 3 == 1]
        want += [(f"q{q}", i, float(score[i]), n + 1) for n, i in enumerate(sorted(own, key=lambda i: (-score[i], i))[:4])]
    assert got == sorted(want)
    if keep is None:
        assert vector_index.scanned_share(queries, index, 4) < 0.3
    assert vector_index.nearest_vectors(queries.limit(0), index).count() == 0
    assert vector_index.nearest_vectors(queries, vector_index.build_vectors(table.limit(0), folder(spark, "vectors"), ("label",))).count() == 0
