"""Operators 11 to 13 against plain versions, on the smallest tables and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from fieldwise.llm import fingerprints, queries, source_divergence, token_alignment
from fieldwise.llm.token_output import SHOWN

#: Columns beyond those of documents bear names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run long, kind int, pair long, key string, h long, kept string, term string, n long, total long"
REST = (7, 7, 7, 7, "z", 7, "z", "z", 7, 7)
ODD = [
    (1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "one two three four five six seven"), (3, None), (4, ""), (5, " \n\t "), (6, "a b"), (7, "a b"),
    (None, "one two"), (None, None), (8, "x " * 30_000), (9, "é ş x"), (10, "▁ has no tokens"), (11, "<s> plain <|endoftext|>"), (12, "a  b \n c "),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None if i == 6 else "l", None if i == 7 else "s", *REST) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def aligned_plainly(texts, tokenizers):
    """Whole texts through both tokenizers, spans of bytes, all overlapping pairs."""
    (a, b), of = tokenizers, {c: i for i, c in enumerate(SHOWN)}
    found, counts = [], Counter()
    for text in texts:
        found.append(None)
        if not text:
            continue
        whole, ids_a, ids_b = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            continue
        spans = []
        for tokens in (bytes_a, bytes_b):
            ends = [sum(map(len, tokens[: k + 1])) for k in range(len(tokens))] if len(tokens) < 2000 else list(pd.Series(map(len, tokens)).cumsum())
            spans.append([(e - len(t), e) for t, e in zip(tokens, ends, strict=True)])
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        where = [pd.Series([e for _, e in s]).searchsorted(cuts, side="right") for s in spans]
        groups = [(ids_a[la:ha], ids_b[lb:hb]) for la, ha, lb, hb in zip([0, *where[0][:-1]], where[0], [0, *where[1][:-1]], where[1], strict=True)]
        links, at = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][at][1] <= s:
                at += 1
            j = at
            while j < len(ids_b) and spans[1][j][0] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        counts.update(links)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found[-1] = (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(said.encode()).hexdigest())
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (*x[:3], len(x[3]), sum(counts[p] == most[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for x in found]


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def by_id(got, columns):
    return sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in got.collect())


def test_alignment(spark, odd, none, tokenizers):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = sorted((str(i), *x) for i, x in zip(docs.doc_id, aligned_plainly(docs.text, tokenizers), strict=True))
    assert by_id(queries.QUERIES["op11_token_alignment"](spark, SF), ALIGNED) == want
    got = by_id(token_alignment.alignment(odd), ALIGNED)
    assert got == sorted((str(i), *x) for (i, _), x in zip(ODD, aligned_plainly([t for _, t in ODD], tokenizers), strict=True))
    assert token_alignment.alignment(none).count() == 0


def test_alignment_in_small_runs(spark, tokenizers, monkeypatch):
    """Texts of awkward white space, in runs of a few units each, with copies."""
    r, signs = random.Random(5), [" ", "  ", "\n", "a", "bc", "é", "'s", "1", "\t", "!", " ", "ス", "　", "<s>", "ing", "‍", "\U0001f600", "\x00"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 25))) for _ in range(400)] * 2
    own = token_alignment.units
    assert all((" " + t).encode() == b"".join((" " + u).encode() for u in own(t)) for t in texts if t)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    texts_once = docs.groupBy("text").agg(F.count(F.lit(1)).alias("times")).select(F.unhex(F.sha2("text", 256)).alias("text_key"), "text", "times")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

    def in_runs(it):
        token_alignment.UNITS = 20
        return token_alignment.aligned(it, *paths)

    runs = token_alignment.written(texts_once.mapInArrow(in_runs, token_alignment.RUNS), "aligned")
    assert runs.select("run").distinct().count() > 20
    monkeypatch.setattr(token_alignment, "text_runs", lambda *_: runs)
    got = by_id(token_alignment.alignment(docs), ALIGNED)
    assert got == sorted((str(i), *x) for i, x in enumerate(aligned_plainly(texts, tokenizers)))


WORD = re.compile(r"[^ \t-\r]+")


def shingle_set(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    texts, got = [t or "" for t in docs.text], queries.QUERIES["op12_fingerprints"](spark, SF).toPandas().sort_values("doc_id")
    assert list(got.doc_id) == list(docs.doc_id)
    apart = []
    for i, r in enumerate(got.itertuples()):
        own, after = texts[i], texts[(i + 1) % len(texts)]
        k = len(own) // 4
        edited = own[: len(own) - k] + after[:k]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        apart += [abs(r.near_edited - alike(shingle_set(own), shingle_set(edited))), abs(r.near_next - alike(shingle_set(own), shingle_set(after)))]
    assert sum(apart) / len(apart) < 0.05
    assert len(set(zip(texts, got.fingerprint, strict=True))) == len(set(texts))


def test_sketches(spark, odd, none):
    got = fingerprints.compare_with_edits(odd).toPandas()
    assert len(got) == len(ODD) and got.doc_id.isna().sum() == 2 and fingerprints.compare_with_edits(none).count() == 0
    assert got[got.doc_id == 2].fingerprint.nunique() == 1 and set(got[got.doc_id.isin([3, 4, 5])].fingerprint) == {""}
    one = fingerprints.compare_with_edits(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    texts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(4000))), (2, " ".join(f"w{i}" for i in range(400)))], "id int, text string")
    kept = texts.select("id", fingerprints.sketch(F.col("text")).alias("kept"))
    back = kept.select("kept", fingerprints.from_fingerprint(fingerprints.fingerprint(F.col("kept"))).alias("back")).collect()
    assert all(r.kept == r.back for r in back)
    both = kept.alias("a").join(kept.alias("b"), F.expr("a.id = 2 and b.id = 1"))
    r = both.select(fingerprints.containment(F.col("a.kept"), F.col("b.kept")).alias("inside"), fingerprints.likeness(F.col("a.kept"), F.col("b.kept")).alias("like")).first()
    assert r.inside == 1.0 and 0.07 < r.like < 0.13
    assert fingerprints.merged(kept.withColumn("g", F.lit(1)), "g").count() == len(kept.where("id = 1").first().kept)


def test_neighbours_over_many_ranges(spark):
    ids = spark.range(500).select(F.struct(F.when(F.col("id") > 3, F.col("id") * 7).alias("doc_id"), F.col("id").alias("h")).alias("key"))
    got = {(r.key.doc_id, r.key.h): (r.next_key.doc_id, r.next_key.h) for r in fingerprints.neighbours(ids.union(ids)).collect()}
    keys = sorted(got, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert len(got) == 500 and all(got[a] == b for a, b in zip(keys, keys[1:] + keys[:1], strict=True))


def test_divergence_on_awkward_rows(spark, odd, none, monkeypatch):
    import duckdb

    documents = odd.union(odd.limit(0)).toPandas()  # noqa: F841  (DuckDB reads it by name)
    want = duckdb.sql(source_divergence.OP13_SQL).df()
    assert rows(source_divergence.divergence(odd).toPandas()) == rows(want)
    assert source_divergence.divergence(none).count() == 0
    # Terms that meet only through different chunks, some of one document, and chunks in thousands of variants.
    texts = [(i, f"Word, word. (WORD) x{i}-shared-y{i} https://a.b/{i}/Été", "ab"[i % 2], f"s{i % 3}") for i in range(40)] + [(50, " ".join(f"only{i}.dup" for i in range(3000)), "a", "s0")]
    documents = pd.DataFrame(texts, columns=["doc_id", "text", "lang", "source"])
    got = source_divergence.divergence(spark.createDataFrame(documents).repartition(5))
    assert rows(got.toPandas()) == rows(duckdb.sql(source_divergence.OP13_SQL).df())
    assert not got.where("item = 'dup' or item = 'only'").count() and got.where("item = 'shared'").count()


def test_tallies_that_are_handed_on_early(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])

    def small(step):
        def run(batches):
            source_divergence.HELD = 500
            return step(batches)

        return run

    s = source_divergence
    chunks = docs.mapInArrow(small(s.count_chunks), s.SCHEMA)
    terms = chunks.repartition("item").sortWithinPartitions("item", "lang").mapInArrow(small(s.chunks_to_terms), s.SCHEMA)
    kept = terms.repartition("lang", "item").sortWithinPartitions("item", "lang").mapInArrow(small(s.kept_terms), "lang string, term string, sources array<string>, ns array<long>")
    columns = ["lang", "term", F.sort_array(F.arrays_zip("sources", "ns")).cast("string").alias("n")]
    assert rows(kept.select(*columns).toPandas()) == rows(s.term_counts(docs).select(*columns).toPandas()) and kept.count() > 100


def test_shares_of_large_counts():
    import numpy as np

    r = random.Random(3)
    total = [r.randint(10, 9 * 10**15) for _ in range(500)]
    n = [r.randint(0, t) for t in total]
    assert source_divergence.shares(np.array(n), np.array(total)).tolist() == [1 + 10**9 * a // b for a, b in zip(n, total, strict=True)]


def test_counts_and_documents_of_a_row_share_one_list():
    import numpy as np

    s = source_divergence
    counts = s.Counts()
    key = np.array([counts.items.setdefault(x, len(counts.items)) << s.LANG_BITS for x in (b"a", b"b")])
    counts.langs["en"], counts.sources["x"], counts.sources["y"] = 0, 0, 1
    counts.add(key[[0, 0, 1]], np.array([0, 1, 1]), np.array([5, 6, 7]), key[[0, 0]], np.array([100, 101]), key[[1]])
    (batch,) = counts.rows()
    assert batch.to_pylist() == [{"lang": "en", "item": "a", "sources": ["x", "y"], "numbers": [5, 6, 100, 101]}, {"lang": "en", "item": "b", "sources": ["y"], "numbers": [7]}]
    row, sources, ns, doc_row, docs, full = s.flat(batch)
    assert (row.tolist(), sources.to_pylist(), ns.tolist(), doc_row.tolist(), docs.tolist(), full.tolist()) == ([0, 0, 1], ["x", "y", "y"], [5, 6, 7], [0, 0], [100, 101], [1])


def test_new_units_are_encoded_in_rows():
    """Also beside units that no tokens give back, and those after which a space doesn't start anew; units keep what is known of them when others are forgotten."""
    both = token_alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    own, given = both.ids_a, []
    both.ids_a = lambda texts: given.extend(texts) or own(texts)
    units = [f"unit{i}," for i in range(3000)] + ["a▁b", "end ", "tab\t", "", " x", "déjà", "ｆull"]
    both.learn(units)
    assert len(given) < 300

    def known(u):
        measures, pairs, groups = both.known()
        i = both.number[u]
        at = measures[:i, 3].sum()
        return measures[i].tolist(), pairs[at : at + measures[i, 3]].tolist(), groups[i].as_py()

    want = {}
    for u in units:
        alone = token_alignment.Aligner.__new__(token_alignment.Aligner)
        alone.__dict__ |= both.__dict__ | {"number": {}, "_measures": both._measures[0][:0], "ids_a": own}
        alone._measures, alone._pairs, alone._groups = [both.known()[0][:0]], [both.known()[1][:0]], [both.known()[2][:0]]
        alone.learn([u])
        (measures,), pairs, (groups,) = alone.known()
        want[u] = measures.tolist(), pairs.tolist(), groups.as_py()
        assert known(u) == want[u]
    assert want["a▁b"] == ([0, 0, 0, 0], [], "")
    both.forget()
    assert 0 < len(both.number) < len(units)
    assert all(known(u) == want[u] for u in both.number)
