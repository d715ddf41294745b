"""The corpus operators against SQL, brute force and exact round trips, on the smallest tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from fieldwise.llm import chat_format, decontamination, mixing, ngram_join, quality_rules, queries, store, substring_dedup, token_counts, token_output, toxicity, url_filter

WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, sid long, count long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names the operators use themselves."""
    prose = " ".join(f"word{i}" for i in range(60))
    texts = [(1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \n\t "), (6, "a b"), (7, "a b"), (None, prose), (8, prose + " tail"), (9, "x " * 30_000), (10, "é ş\u00a0x")]
    return spark.createDataFrame([(i, t, None, "s" if i and i % 2 else None, 1, "z", 5, 6) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_decontamination(spark, odd, none):
    docs, items = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    known = [(i, len(w), Counter(shingles(w))) for i, w in ((i, WORD.findall(low(t))) for i, t in items[["item_id", "text"]].itertuples(index=False))]
    want = set()
    for doc, text in docs[["doc_id", "text"]].itertuples(index=False):
        own = shingles(WORD.findall(low(text)))
        for item, n, weights in known:
            if not weights.keys().isdisjoint(own):
                size = min(n, len(own) + 4)
                sums = [(sum((c & weights).values()), c.total()) for c in (Counter(own[s : s + size - 4]) for s in range(len(own) + 5 - size))]
                if max(100 * o - 75 * (t + weights.total() - o) for o, t in sums) >= 0:
                    want.add((doc, item))
    got = queries.QUERIES["op1_benchmark_decontamination"](spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    bench = spark.createDataFrame([(1, "A b"), (2, None), (3, ""), (4, " ".join(f"word{i}" for i in range(5, 40)))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(odd, bench).collect()}
    assert found == {(6, 1), (7, 1), (1, 4), (2, 4), (8, 4), (None, 4)}
    left = decontamination.without_leaks(odd, bench)
    assert left.columns == odd.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 9, 10]
    assert decontamination.leaks(none, bench).count() == 0 and decontamination.leaks(odd, bench.limit(0)).count() == 0


def test_rolled_prints_and_their_recall():
    rng = np.random.default_rng(11)
    grams = rng.integers(0, 1 << 63, 9000, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    got = decontamination.rolled(grams, 37)
    for at in (0, 1, 36, 4095, 4096, 4097, len(got) - 1):
        whole = np.unpackbits(np.frombuffer(np.uint64(got[at]).tobytes(), np.uint8))
        want = np.unpackbits(np.frombuffer(grams[at : at + 37].tobytes(), np.uint8).reshape(37, 8), axis=1).sum(0) * 2 > 37
        assert (whole == want).all()
    # Items and windows of a similarity of 0.75 to 0.80: the multi-index must name the item in 0.99 of them, and brute force agrees on which are within the radius.
    items, windows = [], []
    for _ in range(1500):
        item = rng.integers(0, 1 << 62, 60, dtype=np.int64).astype(np.uint64)
        window = item.copy()
        window[rng.choice(60, 7, replace=False)] = rng.integers(0, 1 << 62, 7, dtype=np.int64).astype(np.uint64)  # 53 of 67
        items.append(decontamination.rolled(item, 60)[0])
        windows.append(decontamination.rolled(window, 60)[0])
    index = decontamination.MultiIndex(list(range(len(items))), items)
    found = set(index.candidates(np.array(windows, np.uint64)))
    near = np.bitwise_count(np.array(windows)[:, None] ^ np.array(items)[None, :]) <= decontamination.RADIUS
    assert found == set(zip(*map(list, np.nonzero(near)), strict=True))
    assert sum((i, i) in found for i in range(len(items))) >= 0.99 * len(items)


def test_long_repetitive_items(spark):
    """A long text that says one thing over and over, as item and as document."""
    text = "to be or not to be that is " * 4000
    docs = spark.createDataFrame([(1, text + text), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text), (2, "to be or not to be that is the question of all")], "item_id long, text string")
    got = [tuple(r) for r in decontamination.leaks(docs, bench).collect()]
    assert got == [(1, 1, 0, 32_000, 1.0)]


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1?x=1", "https://b.org/fr/", "https://c.org/fr", "http://q.example.com/de/x", "http://net", "http://a.net/", None, "", "no scheme", "http://x.com/" + "a" * 5000, "http://é.com/?q#f", "a://b://net/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return (host, path, *(max(fits)[1:] if fits else (None, None)))

    for r in url_filter.judge_urls(pages).collect():
        host, path, rule, verdict = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("block", "allow") and verdict in (None, r["verdict"])
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    labels = spark.createDataFrame([(f"http://{'bad9' if i % 2 else 'good'}{i}.com/{i}", i % 2) for i in range(80)], "url string, blocked int")
    got = url_filter.judge_urls(spark.createDataFrame([(1, "http://bad977.com/7"), (2, "http://good12.com/9")], "page_id long, url string"), (), labels)
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "allow"}


def test_url_trees_on_held_out_urls(spark):
    """Labelled URLs of two kinds that differ in digits, depth and parameters, under the same hosts; accuracy on those that weren't trained on."""
    rng = random.Random(21)

    def url(blocked):
        word = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9)))
        host = f"{word}.{rng.choice(['com', 'org:8080', 'io'])}"
        if blocked:
            return f"http://{host}/" + "/".join(str(rng.randrange(10**5)) for _ in range(rng.randrange(2, 6))) + f"?id={rng.randrange(10**6)}&s={rng.randrange(99)}"
        return f"http://{host}/" + "/".join(rng.choice(["news", "about", "story", "page"]) for _ in range(rng.randrange(1, 4)))

    rows = [(i, url(i % 2), i % 2) for i in range(600)]
    labels = spark.createDataFrame([(u, y) for i, u, y in rows if i < 400], "url string, blocked int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u, _ in rows if i >= 400], "page_id long, url string"), (), labels).collect()}
    assert sum(got[i] == ("block" if y else "allow") for i, _, y in rows if i >= 400) >= 190


def test_token_files(spark, odd, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        at = 0
        want = []
        for doc, text in sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
            want.append((doc, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
            at += len(ids)
        got = [tuple(r) for r in token_output.encode_and_read(df, path).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert token_output.encode_and_read(none, path).count() == 0


def test_token_files_are_pruned(spark, tmp_path):
    """Files hold Bloom filters and row indexes, and a look-up by id reads few of their rows."""
    import public_tokenizers

    path = str(tmp_path / "tokens")
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    token_output.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    jvm = spark._jvm
    conf, files = jvm.org.apache.hadoop.conf.Configuration(), sorted((tmp_path / "tokens").glob("*.orc"))
    seen = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{f}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_output.STRIDE
        tail = reader.getFileTail().getFooter()
        for i in range(tail.getStripesCount()):
            assert tail.getStripes(i).getIndexLength() > 0
        streams = b"BLOOM" in f.read_bytes() or reader.getFileTail().getFooter().getStripes(0).getIndexLength() > 1000
        seen += streams
    assert seen == len(files) > 1
    rows = spark.read.schema(token_output.SCHEMA).orc(path).where("doc_id = 31337")
    assert rows.count() == 1
    rows = rows.select("doc_id", "n_tokens")
    rows.collect()
    assert "EqualTo(doc_id,31337)" in rows._jdf.queryExecution().executedPlan().toString()


def test_near_copies(spark, odd, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(odd).collect()}
    assert {(1, 56, 1), (2, 56, 1), (8, 57, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (None, 56, None)} <= got
    kept = ngram_join.drop_copies(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=lambda i: i or 0) == [None, 1, 3, 4, 5, 6, 9, 10]
    assert ngram_join.near_copies(none).count() == 0


def test_trie_pairs_are_all_links():
    rng = np.random.default_rng(3)
    sets = []
    for base in range(6):
        core = set((rng.choice(10_000, 40, replace=False) + base * 10_000).tolist())
        for _ in range(8):
            gone = set(rng.choice(sorted(core), rng.integers(0, 9), replace=False).tolist())
            sets.append((core - gone) | set(rng.integers(10**6, 10**7, rng.integers(0, 5)).tolist()))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    order = [sorted(s) for s in sets]
    prefix = [s[: len(s) - (3 * len(s) + 3) // 4 + 1] for s in order]
    count = Counter(x for p in prefix for x in p)
    got = set()
    for key in count:
        members = []
        for i, p in enumerate(prefix):
            shared = [x for x in p if count[x] > 1]
            if key in shared:
                at, n = shared.index(key), len(order[i])
                keys, beyond = shared[at : at + 6], n - len(p)
                members.append((i, n, i, len(shared) + beyond >= ngram_join.needed(n, n), keys, len(shared) - at - len(keys) + beyond, frozenset(shared[max(0, at - 6) : at])))
        got |= {(o.sid, e.sid) for o, e in ngram_join.trie_pairs(members)}
    assert {(max(p), min(p)) for p in got} >= want and want


def test_trie_pairs_of_texts_contained_in_longer_ones():
    """Frequent shingles, late in the order, in sets that stand in others with rare shingles besides, with and without the prefix's end."""
    rng = random.Random(4)
    sets = []
    for base in range(12):
        core = rng.sample(range(10**6 * (base + 1), 10**6 * (base + 1) + 5000), rng.randrange(30, 120))
        sets += [set(core), set(core) - set(rng.sample(core, 3))]
        for _ in range(6):
            sets.append(set(core) | {rng.randrange(10**6) for _ in range(rng.randrange(len(core) // 6, len(core) // 3 + 1))})
        passage = set(core[:8])
        sets += [passage | {rng.randrange(10**6, 10**8) for _ in range(60)} for _ in range(4)]
    jaccard = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i)}
    want = {p for p, x in jaccard.items() if x >= 0.75}
    assert sum(x < 0.85 for p, x in jaccard.items() if p in want) > 20
    order = [sorted(s) for s in sets]
    prefix = [s[: len(s) - (3 * len(s) + 3) // 4 + 1] for s in order]
    count = Counter(x for p in prefix for x in p)
    for more in (False, True):
        got = set()
        for key in count:
            members = []
            for i, p in enumerate(prefix):
                shared = [x for x in p if count[x] > 1]
                if key in shared:
                    at, n = shared.index(key), len(order[i])
                    keys, beyond = shared[at : at + ngram_join.AHEAD], n - len(p)
                    m = (i, n, i, len(shared) + beyond >= ngram_join.needed(n, n), keys, len(shared) - at - len(keys) + beyond, frozenset(shared[max(0, at - ngram_join.AHEAD) : at]))
                    members.append((*m, [p.index(k) for k in keys], p[-1]) if more else m)
            got |= {(o.sid, e.sid) for o, e in ngram_join.trie_pairs(members)}
        assert {(max(p), min(p)) for p in got} >= want


def test_near_copies_of_a_text_contained_in_a_longer_one(spark):
    texts = []
    for case, extra in enumerate((31, 32, 33, 34, 20)):
        core = " ".join(f"c{case}w{i}" for i in range(104))
        texts += [core] * 6 + [core + "".join(f" e{case}x{i}" for i in range(extra))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(docs).collect()}
    # 100 shingles of 100 + extra: 0.75 is reached up to 33.
    assert got == {i: i if i == 7 * 3 + 6 else i // 7 * 7 for i in range(35)}


def test_large_group_of_near_copies(spark):
    """5,000 near copies, beside texts that are near them without a link: what is asked and verified stays in proportion to the rows."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(5000):
        words = base.copy()
        words[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(words))
    far = []
    for i in range(20):
        words = base.copy()
        for at in range(0, 120, 12):
            words[at] = f"y{i}z{at}"
        far.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts + far)), "doc_id long, text string").repartition(4).cache()
    asked = []
    links = ngram_join.links

    def counted(corpus, asks, members):
        asked.append(asks.count())
        return links(corpus, asks, members)

    ngram_join.links = counted
    try:
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(docs).collect()}
    finally:
        ngram_join.links = links
    shingles = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts + far]
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    parent = list(range(len(shingles)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(shingles):
        # Every near copy is within one changed word of the base, so it is enough to look at a few hundred others for a link.
        for j in [*range(min(i, 300)), *range(5000, i)]:
            if top(i) != top(j) and near(own, shingles[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    assert [got[i] for i in range(len(shingles))] == [top(i) for i in range(len(shingles))]
    assert max(asked) <= len(shingles), asked


def test_blocks_answer_as_brute_force_does():
    rng = random.Random(9)
    sets = {}
    for base in range(5):
        core = rng.sample(range(10_000 * base, 10_000 * base + 500), rng.randrange(1, 60))
        for k in range(12):
            sets[base * 100 + k] = sorted((set(core) - set(rng.sample(core, rng.randrange(0, max(1, len(core) // 6))))) | {rng.randrange(10**6) for _ in range(rng.randrange(len(core) // 6 + 1))})
    trie = ngram_join.whole_trie(sets)
    for sid, own in sets.items():
        want = {o for o, other in sets.items() if 100 * len(set(own) & set(other)) >= 75 * len(set(own) | set(other))}
        assert set(trie.links(set(own))) == want and sid in want


def test_bitmaps_never_hide_a_link():
    import pyarrow as pa

    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.int64)) for n in (1, 2, 31, 33, 100, 500, 1100)]
    for own in list(sets):
        for gone in (1, len(own) // 9, len(own) // 4, len(own) // 2):
            sets.append(np.unique(np.concatenate([own[gone:], rng.integers(0, 1 << 62, gone // 3, dtype=np.int64)])))
    sets = [x for x in sets if len(x)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    bits = ngram_join.bitmaps(np.concatenate(sets).astype(np.uint64), at).to_pylist()
    row = lambda block, asks, i: {"block": block, "part": 0, "asks": asks, "sid": i, "n": len(sets[i]), "bits": bits[i]}
    rows = [row(j, False, j) if i < 0 else row(j, True, i) for j in range(len(sets)) for i in range(-1, len(sets))]
    got = {(r["sid"], r["block"]) for b in ngram_join.likely(iter(pa.Table.from_pylist(rows).to_batches(max_chunksize=100))) for r in b.to_pylist()}
    own = [set(x.tolist()) for x in sets]
    link = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j])}
    assert got >= link and len(got) < len(sets) ** 2 / 4


def test_shared_shingles_of_sorted_rows():
    import pyarrow as pa

    rows = [(1, 1), (2, 1), (2, 1), (3, 1), (3, 2), (3, 2), (4, 5), (5, 1), (5, 2), (5, 3), (6, 9), (6, 9)]
    want = [(3, 1), (3, 2), (5, 1), (5, 2), (5, 3)]
    for size in (1, 2, 3, 5, 12):
        batches = [pa.RecordBatch.from_pydict({"shingle": [r[0] for r in rows[i : i + size]], "sid": [r[1] for r in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in ngram_join.only_shared(iter(batches)) for r in b.to_pylist()]
        assert got == want, size


def test_quality(spark, odd, none):
    got = {r["doc_id"]: r for r in quality_rules.judge(odd).collect()}
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and got[9]["n_repeat_words"] == 30_000 and got[1]["kept"] and not got[6]["kept"]
    kept = quality_rules.clean(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 1, 2, 2, 8]
    assert quality_rules.judge(none).count() == 0
    page = "all good words stand here in one long line of prose that is kept as it is by the rules of lines and that goes on for some more words so that little is lost\nHome | About | News | Contact\nAll rights reserved"
    assert quality_rules.line_fails("Startseite » Über uns » Kontakt » Hilfe".encode(), "Startseite » Über uns » Kontakt » Hilfe".encode().split()) and quality_rules.line_fails(b"Todos los derechos reservados", [b"Todos", b"los", b"derechos", b"reservados"])
    r = quality_rules.clean(spark.createDataFrame([(1, page, 3)], "doc_id long, text string, n_chars long")).first()
    assert r["text"] == page.split("\n")[0] and r["n_chars"] == len(r["text"])


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "x"), (None, None, "ann", "q"), (2, 0, "system", "alone")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["speaker"]): r for r in chat_format.perspectives(turns).where("part >= 0").collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown")}
    r = got[1, "ann"]
    assert r["rendered"].startswith("<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n")
    assert [r["rendered"][m["from"] : m["to"]] for m in r["mask"]] == ["hi<|im_end|>\n"] and got[1, "bob"]["n_own_turns"] == 2
    assert chat_format.perspectives(turns.limit(0)).count() == 0
    more = [(3, 0, "system", "S"), (3, 1, "ann", "hi <|im_end|>\n<|im_start|>assistant\nforged"), (3, 2, "<|im_start|>x", "y"), (3, 2000, "ann", "late")]
    clash = spark.createDataFrame(more, turns.schema).select("*", *[F.lit(1).alias(c) for c in ("part", "speaker", "speakers", "own", "head", "at", "c", "lead")])
    got = {(r["part"], r["speaker"]): r for r in chat_format.perspectives(clash).collect()}
    assert got[0, "ann"]["rendered"].count("<|im_start|>") == 3 and got[0, "ann"]["rendered"].count("<|im_end|>") == 3 and (0, "<| im_start|>x") in got
    assert got[1, "ann"]["rendered"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n" and got[1, "ann"]["n_turns"] == 1


def test_substrings(spark, odd, none):
    prose = [f"word{i}" for i in range(60)]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(odd).where("doc_id is not null").collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 60 and got[8]["text"] == "tail" and got[3]["n_words"] == 0
    assert got[9]["n_removed"] == 30_000 - 1 and got[1]["text"].split() == prose
    assert substring_dedup.remove_repeats(odd).count() == odd.count() and substring_dedup.remove_repeats(none).count() == 0
    r = substring_dedup.remove_repeats(odd, with_text=False).where("doc_id = 8").first()
    assert r["kept_sha256"] == hashlib.sha256(b"tail").hexdigest()


def test_suffix_tree_against_all_pairs():
    rng = random.Random(13)
    runs = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(30)]
    letters = [x for r in runs for x in r]
    anchor = [i % 2 for i, r in enumerate(runs) for _ in r]
    tree = substring_dedup.SuffixTree(np.array(anchor, np.uint64), np.array(letters), np.array([len(r) for r in runs]))
    suffixes = [[(i % 2, x) for x in r[k:]] for i, r in enumerate(runs) for k in range(len(r))]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    got = [suffixes[i] for i in tree.order]
    assert sorted(tree.order) == list(range(len(suffixes))) and list(tree.lcp[1:]) == [common(a, b) for a, b in zip(got, got[1:], strict=False)]
    doc, pos = np.arange(len(suffixes)) // 4, np.arange(len(suffixes)) % 4
    want = [any(common(suffixes[j], suffixes[i]) for j in range(i)) for i in range(len(suffixes))]
    assert list(tree.repeats(doc, pos)) == want
    # Every string that two suffixes begin with and that they don't share longer is a node.
    nodes = {tuple(suffixes[i][: common(suffixes[i], suffixes[j])]) for i in range(len(suffixes)) for j in range(i)} - {()}
    leaves = sorted((len(x), sum(tuple(s[: len(x)]) == x for s in suffixes)) for x in nodes)
    before = [None if k == 0 else (i % 2, r[k - 1]) for i, r in enumerate(runs) for k in range(len(r))]
    kinds = lambda x: [before[i] for i, s in enumerate(suffixes) if tuple(s[: len(x)]) == x]
    maximal = sorted((len(x), len(kinds(x)), None in kinds(x) or len(set(kinds(x))) > 1) for x in nodes)
    assert sorted(n[:2] for n in tree.deep_nodes()) == leaves and sorted(tree.deep_nodes()) == maximal


def test_mixing(spark, odd, none):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    digest, mix = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), n_shards=5)
    got, again = digest.toPandas(), mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").repartition(7), n_shards=5)[0].toPandas()
    assert rows(got) == rows(again)
    got = got.merge(docs[["doc_id", "source"]], on="doc_id")
    sums = got.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max")).sort_index()
    weights, left, free = np.array([(5, 2, 1)[i % 3] for i in range(len(sums))], float), 1.5 * sums["size"].sum(), np.ones(len(sums), bool)
    want = np.zeros(len(sums))
    while True:
        share = left * weights / weights[free].sum()
        over = free & (share > 2 * sums["size"].to_numpy())
        if not over.any():
            want[free] = share[free]
            break
        want[over] = 2 * sums["size"].to_numpy()[over]
        left, free = left - want[over].sum(), free & ~over
    assert np.allclose(sums["target"], want) and (sums["size"] == sums["own"]).all()
    assert ((sums["taken"] - sums["target"]).abs() <= sums["most"]).all() and (got["taken"] <= 2 * got["size"]).all()
    copies = mix.toPandas()
    assert not copies.duplicated(["doc_id", "copy"]).any() and copies["shard"].between(0, 4).all()
    dealt = copies.groupby("doc_id").size()
    assert (got["taken"] == got["size"] * got["doc_id"].map(dealt).fillna(0)).all()
    clash = odd.select("*", *[F.lit(1).alias(c) for c in ("_s", "place", "size", "block", "copy", "shard", "turn", "dealt", "target")])
    assert mixing.mix(odd)[0].count() == odd.count() and mixing.mixed(clash).columns == clash.columns
    assert sorted(r["doc_id"] or 0 for r in mixing.mixed(clash).collect()) == sorted(r["doc_id"] or 0 for r in mixing.mix(odd)[1].collect())
    assert mixing.mix(none)[0].count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_in_many_blocks(spark, monkeypatch):
    """Small blocks, so that quotas, edges and permuted orders matter: shards get their quotas of whole blocks, and no block twice."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"), F.expr("repeat('w ', cast(id % 50 as int))").alias("text"))
    sizes = mixing.measured(docs)
    dealt = mixing.deal(sizes, 6).collect()
    for r in dealt:
        parts = [(b, c["copy"], c["shard"]) for b, copies in r["dealt"].items() for c in copies]
        assert len({p[:2] for p in parts}) == len(parts) and len({p[2] for p in parts}) == 6 and sum(c["below"] is not None for x in r["dealt"].values() for c in x) <= 1
        assert r["bits"] >= 6 and all(0 <= b < 1 << r["bits"] for b in r["dealt"])
    digest = mixing.mix(docs, 6)[0].toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    sums = digest.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((sums["taken"] - sums["target"]).abs() <= sums["most"]).all()


def test_quotas_against_recursion(spark):
    """The same tree drawn step by step, with exact binomials."""
    from math import comb

    counts = {"a": 40, "b": 7, "c": 0, None: 21}
    blocks = spark.createDataFrame(list(counts.items()), "source string, blocks long")
    got = {(r["source"], r["shard"]): (r["first"], r["quota"]) for r in mixing.quotas(blocks, 5).collect()}
    order = [None, "a", "b", "c"]  # by name, null as an empty one

    def u(lo, hi, s):
        q = f"select shiftrightunsigned(xxhash64({mixing.SEED}, {lo}, {hi}, '{s or ''}', {str(s is None).lower()}), 11) / double(9007199254740992)"
        return spark.sql(q).first()[0]

    def draw(total, own, draws, x):
        lo, hi = max(0, draws + own - total), min(own, draws)
        ways, p = sum(comb(own, k) * comb(total - own, draws - k) for k in range(lo, hi + 1)), 0
        for k in range(lo, hi + 1):
            p += comb(own, k) * comb(total - own, draws - k)
            if p / ways > x:
                return k
        return hi

    def split(own, lo, hi):
        if hi - lo == 1:
            return {(s, lo): n for s, n in own.items()}
        half, total = (hi - lo) // 2, sum(own.values())
        draws = int(total * half / (hi - lo) + 0.5)
        left = {}
        for s in order:
            left[s] = draw(total, own[s], draws, u(lo, hi, s))
            total, draws = total - own[s], draws - left[s]
        return split(left, lo, lo + half) | split({s: own[s] - left[s] for s in order}, lo + half, hi)

    want = split(counts, 0, 5)
    assert {k: v[1] for k, v in got.items()} == want
    for s in order:
        at = 0
        for shard in range(5):
            assert got[s, shard][0] == at
            at += want[s, shard]
        assert at == counts[s]


def test_hypergeometric_shape(spark):
    df = spark.range(2000).select(mixing.hypergeometric(F.lit(20), F.lit(8), F.lit(10), (F.col("id") + 0.5) / 2000).alias("k"))
    p = df.groupBy("k").count().toPandas().set_index("k")["count"] / 2000
    from math import comb

    assert all(abs(p.get(k, 0) - comb(8, k) * comb(12, 10 - k) / comb(20, 10)) < 2e-3 for k in range(9))


def test_token_counts(spark, odd, none):
    pieces = ["▁", "a", "b", "ab", "▁a", "abab", "▁ab", "c"]
    model = token_counts.Unigram(pieces)
    total = np.log(sum(1 / (i + 1) for i in range(len(pieces))))
    score = {p: -np.log(i + 1) - total for i, p in enumerate(pieces)}

    def brute(text):
        if not text:
            return (0.0, 0)
        options = [(score[text[:k]], 1, text[k:]) for k in range(1, len(text) + 1) if text[:k] in score]
        options.append((model.byte * len(text[0].encode()), len(text[0].encode()), text[1:]))
        return max((s + r[0], r[1] - n) for s, n, rest in options for r in [brute(rest)])

    words = sorted({"ab", "abab", "ababa", "é", "aéb", "cab", "bbbb", "abc", "a"})
    assert model.counts(words) == [-brute("▁" + w)[1] for w in words]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(odd).collect()}
    assert got[3] == got[4] == got[5] == (0, 0) and got[1] == got[2] and got[9][0] == 30_000
    assert token_counts.token_counts(none).count() == 0


def test_automaton():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(before[j + 1] + 1, row[j] + 1, before[j] + (x != y)))
        return row[-1]

    terms = {"idiot": 1, "pathetic": 2, "moron": 1}
    machine = toxicity.Automaton(terms)
    rng = np.random.default_rng(1)
    words = ["idiot", "idi0t", "iidiot", "idot", "xdxot", "pathtic", "pathteic", "patic", "", "moro", "mron", "moronx"]
    words += ["".join(rng.choice(list("pathecimorn"), rng.integers(3, 10))) for _ in range(300)]
    for w in words:
        near = [distance(w, t) for t, most in terms.items() if distance(w, t) <= most]
        assert machine.edits(w) == (min(near) if near else None), w


def test_toxicity(spark, odd, none):
    base = [(i, f"plain prose number{i} stands here w{i % 97} x{i % 89} y{i % 83}" + (" idiot" if i % 3 == 0 else "")) for i in range(400)]
    more = [(1001, "what an idi0t"), (1002, "nothing here"), (1003, None), (1004, 'he said "idiot" aloud')]
    docs = spark.createDataFrame(base + more, "doc_id long, text string").withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for i, r in got.items() if i < 400 and r["held_out"]]
    assert held and all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert got[1001]["predicted"] == 1 and got[1002]["predicted"] == 0 and got[1003]["predicted"] == 0 and got[1004]["score"] < got[1001]["score"]
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count() and toxicity.toxicity(none.select("doc_id", "text"), labels).count() == 0


def test_misspellings_with_more_labelled_rows(spark):
    """A misspelling that one clean document has too, and a term with several innocent near words, as the labelled rows grow."""
    innocent = ["bathetic", "cathetic", "dathetic", "fathetic", "gathetic"]
    said = {0: "pathetic", 1: innocent[0], 2: innocent[1], 4: innocent[2], 5: innocent[3], 7: innocent[4]}
    base = [(f"plain prose stands here w{i % 97} x{i % 89} {said.get(i % 9, '')} y{i % 83} z{i}", int(i % 9 == 0)) for i in range(900)]
    base += [(f"prose a{i} pqthetic b{i}", 1) for i in range(4)]
    base = [(t, y) if y or i % 40 == 1 else (" ".join(w for w in t.split() if w not in innocent), y) for i, (t, y) in enumerate(base)]
    for times in (1, 3):
        rows = base * times + [("someone typed pqthetic here", 0)] * (times > 1)
        lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
        seen = {w for t, _ in rows for w in t.split()} & set(innocent)
        assert len(seen) > 3 and seen <= lexicon.innocent and not any(lexicon.weight(w) for w in seen)
        assert lexicon.weight("pathetic") == 1 and 0 < lexicon.weight("pqthetic") < 1 and 0 < lexicon.weight("patjetic") < 1, times


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in p.STAGES[:-1]:
        at = store.written(stage(spark, at, SF), name)
        assert at.columns == docs.columns
    assert at.count() > 0
    got, again = rows(p.run(spark, SF).toPandas()), rows(p.STAGES[-1][1](spark, at, SF).toPandas())
    assert got == again


def shingles_of(text):
    words = WORD.findall(low(text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before kept, by plain Python."""
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    stages = dict(p.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = store.written(stages["quality_rules"](spark, docs, SF), "quality")
    want = {}
    for r in docs.collect():
        words, kept, lost = WORD.findall(r["text"] or ""), [], 0
        grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = {k + j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(8)}
        for line in (r["text"] or "").split("\n"):
            own = WORD.findall(line)
            symbols = len(re.findall(r"[#*$%&|<>]", line))
            bad = own and (symbols * 10 > 3 * len(own) or len(re.findall("!!", line)) * 2 > len(own) or len(re.findall(r"[|»›·]", line)) >= 3 or (len(own) >= 9 and 3 * len(set(own)) <= len(own)) or re.search(quality_rules.BOILERPLATE, low(line)))
            lost += len(own) if bad else 0
            kept += [] if bad else [line]
        if len(words) >= 20 and 100 * len(repeated) <= 30 * len(words) and 100 * lost <= 30 * len(words) and len(words) - lost >= 20:
            want[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in at.collect()} == want and want

    rows_in = sorted((r["doc_id"], r["text"]) for r in at.collect())
    sets, parent = [shingles_of(t) for _, t in rows_in], list(range(len(rows_in)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if top(i) != top(j) and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    at = store.written(stages["near_copies"](spark, at, SF), "near")
    assert sorted(r["doc_id"] for r in at.collect()) == [d for i, (d, _) in enumerate(rows_in) if top(i) == i]

    items = [(WORD.findall(low(t))) for t in pd.read_parquet(f"{SF}/benchmark.parquet")["text"]]
    known = [(len(w), Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))) for w in items]
    clean = []
    for r in at.collect():
        words = WORD.findall(low(r["text"]))
        own = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]

        def leaks(n, weights, own=own):
            if weights.keys().isdisjoint(own):
                return False
            size = min(n, len(own) + 4) - 4
            return any(100 * sum((c & weights).values()) >= 75 * (c.total() + weights.total() - sum((c & weights).values())) for c in (Counter(own[k : k + size]) for k in range(len(own) + 1 - size)))

        if not any(leaks(n, w) for n, w in known):
            clean.append(r["doc_id"])
    at = store.written(stages["decontamination"](spark, at, SF), "clean")
    assert sorted(r["doc_id"] for r in at.collect()) == sorted(clean)

    before, at = at, store.written(stages["mixing"](spark, at, SF), "mixed")
    times = Counter(r["doc_id"] for r in at.collect())
    digest = mixing.mix(before)[0].join(before.select("doc_id", "source"), "doc_id").collect()
    for source in {r["source"] for r in digest}:
        own = [r for r in digest if r["source"] == source]
        assert abs(sum(r["size"] * times[r["doc_id"]] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) and max(times[r["doc_id"]] for r in own) <= 2

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for doc, text in sorted((r["doc_id"], r["text"]) for r in at.collect()):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in stages["token_output"](spark, at, SF).collect()), key=lambda r: r[1]) == want


def test_components_of_links_that_come_in_turns(spark):
    rng = random.Random(5)
    roots, parent = None, {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    turns = [[(i, i + 1) for i in range(-40, 0)], [(rng.randrange(-60, 200), rng.randrange(-60, 200)) for _ in range(40)], [], [(5, 5)], [(rng.randrange(-60, 200), rng.randrange(-60, 200)) for _ in range(60)]]
    for links in turns:
        roots = ngram_join.joined(roots, spark.createDataFrame(links, "a long, b long"))
        for a, b in links:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
        got = {r["id"]: r["root"] for r in roots.collect()}
        assert len(got) == roots.count()
        assert {x: got.get(x, x) for x in parent} == {x: top(x) for x in parent}


def test_a_join_plans_few_jobs_and_sends_no_table_of_its_sets_to_the_driver_without_need(spark, tmp_path):
    """Every query leaves its plan with the driver, and a table to be broadcast passes through it."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 40)) for _ in range(30)]
    rows = [(10 * i + k, " ".join(["x"] * k + t.split()[k:])) for i, t in enumerate(texts) for k in range(4)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    queries = spark._jsparkSession.sharedState().statusStore()
    before = queries.executionsCount()
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(spark.read.parquet(path)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}
    assert queries.executionsCount() - before <= 70


def test_small_groups_and_unasked_blocks_plan_no_queries_of_their_own(spark, tmp_path):
    """Without a large group or a much-asked block there is nothing to deal out, and nothing is counted by a query of its own."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 40)) for _ in range(30)]
    rows = [(10 * i + k, " ".join(["x"] * k + t.split()[k:])) for i, t in enumerate(texts) for k in range(4)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    queries = spark._jsparkSession.sharedState().statusStore()
    before = queries.executionsCount()
    got = sorted(r["doc_id"] for r in ngram_join.drop_copies(spark.read.parquet(path)).collect())
    assert got == [10 * i for i in range(30)]
    assert queries.executionsCount() - before <= 46


def test_a_write_counts_its_rows(spark):
    assert [store.written_and_counted(spark.range(n), "rows")[1] for n in (0, 1, 1000)] == [0, 1, 1000]
    none, n = store.written_and_counted(spark.range(10).where("id < 0").groupBy("id").count(), "rows")
    assert n == none.count() == 0
    assert store.written_and_counted(spark.createDataFrame([], "a long"), "rows")[1] == 0


def test_the_driver_gives_back_what_its_heap_does_not_hold(spark):
    pid = spark._jvm.java.lang.management.ManagementFactory.getRuntimeMXBean().getPid()
    status = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    unsafe = spark._jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    unsafe.setAccessible(True)
    unsafe, before = unsafe.get(None), status()
    blocks = [unsafe.allocateMemory(65536) for _ in range(1600)]
    for at in blocks:
        unsafe.setMemory(at, 65536, 1)
    for at in blocks[:-1]:
        unsafe.freeMemory(at)
    store.give_back_driver(spark)
    assert status() - before < 60
    unsafe.freeMemory(blocks[-1])


def test_ids_are_packed_as_little_endian_integers():
    for n in (0, 1, 15, 16, 40):
        ids = list(range(2**31 - n, 2**31))
        assert token_output.packed(ids) == np.asarray(ids, "<i4").tobytes()


def test_a_worker_drops_the_words_of_another_operator():
    import weakref

    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    left = weakref.ref(token_output.encoder(path))
    assert token_output.encoder(path) is left()
    docs = pa.record_batch({"doc_id": [1], "text": ["a b c d e f"]})
    assert len(list(ngram_join.signatures(iter([docs]), np.empty(0, np.uint64), np.empty(0, np.int64)))) == 1
    assert left() is None


def test_a_task_gives_its_memory_back(tmp_path):
    """In a process of its own, as what others have allocated would count."""
    import subprocess
    import sys

    code = """
import pyarrow as pa
from fieldwise.llm import quality_rules
def held():
    return sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon")) / 1024
text = " ".join(f"word{i}" for i in range(400))
batch = pa.record_batch({"doc_id": range(8000), "text": [text + str(i) for i in range(8000)]})
list(quality_rules.judged(iter([batch.slice(0, 10)]), False, 30))
before = held()
for _ in quality_rules.judged(iter([batch]), False, 30):
    pass
print(held() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(done.stdout) < 25


def test_batches_to_workers_are_bounded_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": [batch.nbytes]})

    docs = spark.range(0, 9_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 400).alias("text"))
    own = spark.conf.get(store.BATCH_BYTES)
    try:
        spark.conf.set(store.BATCH_BYTES, "67108864b")
        quality_rules.clean(docs)
        assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 5 << 20
        spark.conf.set(store.BATCH_BYTES, "9m")
        quality_rules.clean(docs)
        assert spark.conf.get(store.BATCH_BYTES) == "9m"
    finally:
        spark.conf.set(store.BATCH_BYTES, own)


def test_each_word_of_a_batch_is_looked_up_once():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Counted(dict):
        lookups = 0

        def __getitem__(self, key):
            Counted.lookups += 1
            return super().__getitem__(key)

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["one two one Two " * 500, None, "", " \t\x0b", " three,four\x1cfive six　 \n", "É é"]
    enc = token_output.Encoder(path)
    enc.known = Counted()
    for _ in range(2):
        n, ids = enc.encode(pa.array([*texts, "a row before"]).slice(0, len(texts)), 2)
        want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert n.tolist() == list(map(len, want))
        assert ids.tolist() == [i for x in want for i in x]
    assert Counted.lookups <= 2 * 10


def test_each_stage_drops_the_words_of_token_output():
    import weakref

    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = pa.record_batch({"doc_id": [1], "text": ["a b c d e f"]})
    for task in (lambda: quality_rules.judged(iter([docs]), False, 30), lambda: ngram_join.sets_of(iter([])), lambda: ngram_join.answered(iter([]))):
        left = weakref.ref(token_output.encoder(path))
        assert left() is not None
        list(task())
        assert left() is None


def test_words_and_their_parts_share_one_bounded_memory(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "REMEMBERED", 3000)
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, whole, most = token_output.Encoder(path), Tokenizer.from_file(path), 0
    for i in range(20):
        words = ["".join(chr(97 + int(c)) for c in str(i * 200 + j)) for j in range(200)]
        text = " ".join(x for w in words for x in (w, w.title(), w + ",", "é" + w.upper() + "!?"))
        n, ids = enc.encode(pa.array([text + " ! , !? 's"]), 2)
        assert ids.tolist() == whole.encode(text + " ! , !? 's", add_special_tokens=False).ids + [2]
        most = max(most, sum(len(x) for x in vars(enc).values() if isinstance(x, dict)))
    assert most <= 3000 + 200  # the lower-cased words with an accent are parts alone
