"""Operator 7: removal of repeated passages, by sparse suffix trees dealt out by prefix.

A suffix tree of a corpus has a node of depth 20 words or more for every passage of 20 words that stands twice. Such
trees are built here only where they can have deep nodes, and in pieces:

* A suffix is entered at locally consistent sample points: of the 8-word grams inside a window of 20 words, the
  one with the least fingerprint. Equal windows have the same sample point at the same place, so every deep node
  is reached from its sample points.
* The sample gram is the prefix that says which subtree a suffix belongs to; subtrees are dealt by it into groups, as many as keep
  a group at about ``GROUP_TEXT`` bytes of text. Prefixes that a sample of the corpus shows to be heavy (a line that a large part of the documents
  has) are lengthened to the whole 20 words, so a common line doesn't fill one group. The sample steers only where
  rows go, never what is found.
* Inside a group, a run of windows with one sample point is a string whose letters are 20-word fingerprints: its first letter stands for 20 words, each further one for a word more.
  The group's tree is that of all suffixes of its runs, held as their order and the common prefixes of neighbours (a suffix array with its LCP, from which
  the internal nodes can be read). Its internal nodes of depth one letter or more are passages of 20 words or more that stand twice; all leaves of such a node
  but the first in (document, position) order are repeats. ``deep_nodes`` gives the nodes themselves, with their depth in words and whether they are maximal to the left.
* Windows that repeat inside one slab of a task are settled there and sent once, so a passage with very many copies
  costs a row for each slab.

Windows are told apart by 104 bits in a group (64 of the prefix and 40 of the window) and by 64 within a slab. Nulls: a null text has no words; a row
with a null doc_id has no place in the order and is returned as it is. Rows that repeat a doc_id stand for one document read
twice: the second isn't a repeat of the first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.llm.store import shuffle_partitions, table
from fieldwise.llm.text import U64, Words, slices

WINDOW, ANCHOR = 20, 8
#: Bytes of text that are settled together in a task, and that the subtrees of a group come from.
SLAB, GROUP_TEXT = 4 << 20, 8 << 20
#: Documents that are looked at for heavy prefixes, and the share of them that makes a prefix heavy.
PLANNED_ON, HEAVY = 4000, 0.002
RUN = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("n", "<i4")])
LEAF = np.dtype([("low", "<u4"), ("high", "u1")])
BLOBS = "bucket int, runs binary, leaves binary"


def least(x: np.ndarray, k: int) -> np.ndarray:
    """min(x[i : i + k]) for each i; past the end there is nothing smaller."""

    def ahead(v: np.ndarray, by: int) -> np.ndarray:
        out = np.full_like(v, np.iinfo(v.dtype).max)
        if by < len(v):
            out[: len(v) - by] = v[by:]
        return out

    width, m = 1, x
    while width * 2 <= k:
        m = np.minimum(m, ahead(m, width))
        width *= 2
    return np.minimum(m, ahead(m, k - width)) if width < k else m


def windows(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """doc_id, start, prefix and fingerprint of all windows of the texts."""
    words = Words(part.column("text"))
    ok = np.flatnonzero(words.whole(WINDOW))
    prefix, print_ = least(words.grams(ANCHOR), WINDOW - ANCHOR + 1)[ok], words.grams(WINDOW)[ok]
    doc = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    return doc[words.doc[ok]], (ok - words.first[words.doc[ok]]).astype(np.int32), prefix, print_


def in_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pc.sort_indices(batch.column("doc_id")))


def later(doc: np.ndarray, pos: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Rows, in (doc, pos) order, whose key stands on an earlier row of another place."""
    codes, _ = pd.factorize(key)
    again = pd.Series(codes).duplicated().to_numpy()
    if not again.any():
        return again
    first = np.flatnonzero(~again)[codes]
    return again & ((doc != doc[first]) | (pos != pos[first]))


class SuffixTree:
    """The tree of all suffixes of runs of letters, the runs one after the other in (document, position) order.

    order: suffixes in the order of their letters, equal ones by place; lcp: letters that each has in common with the one before it."""

    def __init__(self, high: np.ndarray, low: np.ndarray, lengths: np.ndarray):
        n = len(high)
        self.end = np.repeat(np.cumsum(lengths), lengths)
        # Letters of two parts, each to its rank; then ranks of twice as many letters at a time, as long as runs have them.
        rank = self.ranks(pd.factorize(high)[0].astype(np.int64), low.astype(np.int64))
        self.levels, step = [rank], 1
        while step < int(lengths.max(initial=1)):
            ahead = np.arange(n) + step
            after = np.where(ahead < self.end, rank[np.minimum(ahead, n - 1)] + 1, 0)
            rank = self.ranks(rank, after)
            self.levels.append(rank)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.lcp = np.zeros(n, np.int64)
        left, right = self.order[:-1], self.order[1:]
        common = np.zeros(max(n - 1, 0), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = left + common, right + common
            inside = (a < self.end[left]) & (b < self.end[right])
            same = inside & (self.levels[level][np.minimum(a, n - 1)] == self.levels[level][np.minimum(b, n - 1)])
            common += np.where(same, np.minimum(1 << level, self.end[left] - a), 0)
        self.lcp[1:] = common

    @staticmethod
    def ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Ranks of pairs, those of the first part in any fixed order."""
        by = np.lexsort((second, first))
        a, b = first[by], second[by]
        new = np.ones(len(by), np.int64)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = np.empty(len(by), np.int64)
        out[by] = np.cumsum(new) - 1
        return out

    def repeats(self, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Leaves under an internal node that has an earlier leaf of another place."""
        if not len(self.order):
            return np.zeros(0, bool)
        node = np.cumsum(self.lcp == 0) - 1  # of each suffix, in order: the topmost internal node above it
        opens = np.flatnonzero(self.lcp == 0)
        first = np.minimum.reduceat(self.order, opens)[node]
        out = np.zeros(len(self.order), bool)
        out[self.order] = (doc[self.order] != doc[first]) | (pos[self.order] != pos[first])
        return out

    def deep_nodes(self) -> list[tuple[int, int, bool]]:
        """(letters, leaves, maximal) of every internal node: maximal if its leaves don't all have one and the same letter before them."""
        out, stack = [], [(0, 0)]
        n = len(self.order)
        before = np.where(np.concatenate([[False], self.end[1:] == self.end[:-1]]), np.concatenate([[-1], self.levels[0][:-1]]), -1) if n else self.order
        for i in range(1, n + 1):
            depth, start = (int(self.lcp[i]) if i < n else 0), i - 1 if i < n else n
            while stack[-1][0] > depth:
                deep, start = stack.pop()
                leaves = self.order[start:i]
                own = before[leaves]
                out.append((deep, len(leaves), bool((own < 0).any() or (own != own[0]).any())))
            if stack[-1][0] < depth:
                stack.append((depth, start))
        return out


def spans(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Window starts, in (doc, pos) order, as (doc_id, array of from, to, from, to...) in words."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(new)
    ends = np.concatenate([at[1:], [len(doc)]]) - 1 if len(at) else at
    pairs = np.stack([pos[at], pos[ends] + WINDOW], 1).astype("<i4")
    owner = doc[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = owner[1:] != owner[:-1]
    of = np.flatnonzero(fresh)
    to = np.concatenate([of[1:], [len(at)]]) if len(of) else of
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(owner[of], pa.int64()), "spans": pa.array([pairs[a:b].tobytes() for a, b in zip(of, to, strict=True)], pa.binary())})


def enter(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts to entries of the subtrees, and to repeats settled here (bucket -1 - b)."""
    for batch in batches:
        for part in slices(in_order(batch), most=SLAB):
            doc, pos, prefix, leaf = windows(part)
            again = later(doc, pos, leaf)
            out: dict[str, list] = {"bucket": [], "runs": [], "leaves": []}
            if again.any():
                found = spans(doc[again], pos[again])
                ids, blobs = found.column(0).to_numpy(), found.column(1).to_pylist()
                lengths = np.array([len(x) for x in blobs])
                head = np.zeros(len(ids), RUN)
                head["doc"], head["n"] = ids, lengths
                out = {"bucket": [-1 - int(ids[0] % n_buckets)], "runs": [head.tobytes()], "leaves": [b"".join(blobs)]}
            keep = ~again
            # A repeated row of one document is no repeat, but one entry stands for both.
            keep &= ~pd.Series(leaf).duplicated().to_numpy()
            doc, pos, prefix, leaf = doc[keep], pos[keep], prefix[keep], leaf[keep]
            long = np.isin(prefix, heavy) if len(heavy) else np.zeros(len(prefix), bool)
            prefix = np.where(long, leaf, prefix)
            new = np.ones(len(doc), bool)
            new[1:] = (prefix[1:] != prefix[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
            at = np.flatnonzero(new)
            runs = np.zeros(len(at), RUN)
            runs["anchor"], runs["doc"], runs["pos"] = prefix[at], doc[at], pos[at]
            runs["n"] = np.diff(np.concatenate([at, [len(doc)]]))
            leaves = np.zeros(len(doc), LEAF)
            leaves["low"], leaves["high"] = leaf & U64(0xFFFFFFFF), (leaf >> U64(32)) & U64(0xFF)
            bucket = (runs["anchor"] >> U64(20)) % U64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            sizes = runs["n"][order]
            take = np.repeat(at[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(doc))
            runs, leaves, bucket = runs[order], leaves[take], bucket[order]
            ends = np.cumsum(runs["n"])
            for b in np.unique(bucket):
                lo, hi = np.searchsorted(bucket, [b, b + U64(1)])
                out["bucket"].append(int(b))
                out["runs"].append(runs[lo:hi].tobytes())
                out["leaves"].append(leaves[ends[lo] - runs["n"][lo] : ends[hi - 1]].tobytes())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), "runs": pa.array(out["runs"], pa.binary()), "leaves": pa.array(out["leaves"], pa.binary())})


def resolve(group: pa.Table) -> pa.Table:
    """One group of subtrees: the leaves of deep nodes, but for each node's first, as spans."""
    bucket = group.column("bucket")[0].as_py()
    runs = np.frombuffer(b"".join(group.column("runs").to_pylist()), RUN)
    if bucket < 0:
        blob, at = b"".join(group.column("leaves").to_pylist()), np.concatenate([[0], np.cumsum(runs["n"])])
        return pa.table({"doc_id": pa.array(runs["doc"]), "spans": pa.array([blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})
    leaves = np.frombuffer(b"".join(group.column("leaves").to_pylist()), LEAF)
    begin = np.cumsum(runs["n"]) - runs["n"]
    order = np.lexsort((runs["pos"], runs["doc"]))
    runs, begin = runs[order], begin[order]
    n = runs["n"]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    leaves = leaves[np.repeat(begin, n) + step]
    letter = leaves["low"].astype(np.int64) | (leaves["high"].astype(np.int64) << 32)
    doc, pos = np.repeat(runs["doc"], n), np.repeat(runs["pos"], n) + step.astype(np.int32)
    again = SuffixTree(np.repeat(runs["anchor"], n), letter, n).repeats(doc, pos)
    return pa.Table.from_batches([spans(doc[again], pos[again])])


def heavy_prefixes(docs: DataFrame) -> np.ndarray:
    """Prefixes that stand in many of a bounded sample of documents, for dealing rows out evenly."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    n = rows.select("doc_id").count()
    share = min(1_000_000, max(1, PLANNED_ON * 1_000_000 // max(n, 1)))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("plan")), F.lit(1_000_000)) < share).limit(2 * PLANNED_ON)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, _, prefix, _ = windows(part)
                pairs = pd.DataFrame({"doc": doc, "prefix": prefix}).drop_duplicates()
                counts = pairs["prefix"].value_counts()
                counts = counts[counts >= 2]
                yield pa.RecordBatch.from_pydict({"prefix": pa.array(counts.index.to_numpy(np.uint64).view(np.int64)), "n": pa.array(counts.to_numpy(np.int64))})

    found = picked.repartition(4).mapInArrow(seen, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= max(4, int(PLANNED_ON * HEAVY)))
    return np.sort(np.array([r[0] for r in found.select("prefix").collect()], np.int64).view(np.uint64))


def finish(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "out": []}
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if found:
                cover = np.zeros(n + 1, np.int32)
                for blob in found:
                    pairs = np.frombuffer(blob, "<i4").reshape(-1, 2)
                    np.add.at(cover, pairs[:, 0], 1)
                    np.subtract.at(cover, pairs[:, 1], 1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
            kept = b" ".join(words)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["out"].append(kept.decode() if with_text else hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "text" if with_text else "kept_sha256": pa.array(out["out"], pa.string())})


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): for each document the word spans, of 20 words at least, that stand earlier."""
    spark = docs.sparkSession
    heavy = heavy_prefixes(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(4 * shuffle_partitions(spark), -(-size // GROUP_TEXT))
    entries = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(lambda it: enter(it, heavy, n_buckets), BLOBS)
    return entries.groupBy("bucket").applyInArrow(resolve, "doc_id long, spans binary")


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by a space (or their sha256)."""
    found = repeats(docs).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    joined = docs.select("doc_id", "text").join(found, "doc_id", "left")
    last = "text string" if with_text else "kept_sha256 string"
    return joined.select("doc_id", "text", "spans").mapInArrow(lambda it: finish(it, with_text), f"doc_id long, n_words long, n_removed long, {last}")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


OP7_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as s from w where len(ws) >= 20),
g as (select doc_id, s, md5(array_to_string(ws[s:s+19], ' ')) as g from p),
r as (select doc_id, s from (select doc_id, s, row_number() over (partition by g order by doc_id, s) as nth from g) x where nth > 1),
c as (select distinct doc_id, s + k as i from r cross join (select unnest(range(20)) as k) x),
t as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
k as (select t.doc_id, string_agg(t.word, ' ' order by t.i) as kept, count(*) as n from t left join c on t.doc_id = c.doc_id and t.i = c.i where c.i is null group by t.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""
