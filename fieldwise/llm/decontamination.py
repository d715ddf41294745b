"""Operator 1: benchmark decontamination by SimHash of item-sized windows.

For each size that benchmark items have, windows of so many words are slid over every document. A window's SimHash (64 bits, over its
5-word shingles, each weighted by how often the window has it) is rolled on from the one before: votes of the shingle that enters are added, those of the one that leaves taken off.
The items of that size stand in a multi-index: their fingerprints are cut into four blocks of 16 bits, and an item is a candidate of a window if one block differs in at most a quarter
of the radius and all 64 bits in at most the radius. Two fingerprints within the radius always have such a block, so no item within it is missed.
Candidates are compared exactly: weighted Jaccard, sum of least over sum of greatest weights, 0.75 or more.

Most windows can't be similar to any item, as too few of their shingles stand in the benchmark at all (fewer than 0.75 of an item's); no fingerprints are made of those.
At a similarity of 0.75 the expected distance is 11 of 64 bits, with a deviation of 3; the radius is 22 (tests measure the recall).

Items of fewer than five words are one shingle and match exactly. A document shorter than the item is one window. Null or empty texts and items
match nothing. Items are taken in blocks of bounded size, each sent to all executors, so a benchmark of any size is compared whole.
Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.llm.store import small_batches, table
from fieldwise.llm.text import U64, Words, slices, tidy

K = 5
RADIUS, BLOCKS, BLOCK_BITS = 22, 4, 16
#: Bytes of item text that are sent to the executors at a time.
ITEM_BYTES = 16 << 20
#: In percent.
SIMILAR = 75
#: Windows whose votes are held at once.
STRETCH = 4096


def votes(grams: np.ndarray) -> np.ndarray:
    """One row of 64 bits for each shingle fingerprint."""
    return np.unpackbits(np.ascontiguousarray(grams, "<u8").view(np.uint8)).reshape(len(grams), 64)


def rolled(grams: np.ndarray, span: int) -> np.ndarray:
    """The SimHash of each ``span`` consecutive shingles; a repeated shingle votes each time."""
    n = len(grams) - span + 1
    total = np.zeros(64, np.int64)
    for at in range(0, span, STRETCH):
        total += votes(grams[at : min(at + STRETCH, span)]).sum(0, dtype=np.int64)
    out = np.empty(n, U64)
    for at in range(0, n, STRETCH):
        to = min(at + STRETCH, n)
        change = np.zeros((to - at, 64), np.int64)
        change[1:] = votes(grams[at + span : to + span - 1]).astype(np.int64) - votes(grams[at : to - 1])
        sums = total + np.cumsum(change, axis=0)
        out[at:to] = np.packbits(2 * sums > span, axis=1).view("<u8")[:, 0]
        if to < n:
            total = sums[-1] + votes(grams[to + span - 1 : to + span])[0] - votes(grams[to - 1 : to])[0]
    return out


class MultiIndex:
    """Fingerprints of the items of one size, by Hamming blocks."""

    def __init__(self, items: list[int], prints: list[int]):
        self.items, self.prints = np.array(items), np.array(prints, U64)
        # The blocks' values, each with the items that have it.
        self.blocks = [np.unique(self.block(self.prints, b), return_inverse=True) for b in range(BLOCKS)]

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> U64(b * BLOCK_BITS)) & U64((1 << BLOCK_BITS) - 1)).astype(np.uint16)

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in prints, item) of all pairs within the radius."""
        step = max(1, (1 << 22) // len(self.items))
        for at in range(0, len(prints), step):
            some = prints[at : at + step]
            near = np.zeros((len(some), len(self.items)), bool)
            for b, (values, of) in enumerate(self.blocks):
                own, place = np.unique(self.block(some, b), return_inverse=True)
                close = np.bitwise_count(own[:, None] ^ values[None, :]) <= RADIUS // BLOCKS
                near |= close[place][:, of]
            window, item = np.nonzero(near)
            within = np.bitwise_count(some[window] ^ self.prints[item]) <= RADIUS
            yield from zip((window[within] + at).tolist(), self.items[item[within]].tolist(), strict=True)


class Index:
    """The items of one block: a multi-index for each size, and shingles for the exact comparison."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(pa.array(texts, pa.string()), lower=True)
        self.ids, self.weights = [], []
        prints: dict[int, tuple[list, list]] = {}
        shingles: dict[int, list[np.ndarray]] = {}
        for i, size in enumerate(np.diff(words.first).tolist()):
            if not size:
                continue
            at, k = words.first[i], min(K, size)
            grams = words.grams(k)[at : at + size - k + 1]
            shingles.setdefault(k, []).append(grams)
            items, own = prints.setdefault(size, ([], []))
            items.append(len(self.ids))
            own.append(rolled(grams, len(grams))[0])
            self.ids.append(ids[i])
            self.weights.append(Counter(grams.tolist()))
        self.sizes = {size: MultiIndex(*of) for size, of in sorted(prints.items())}
        #: All shingles of items, by their number of words.
        self.shingles = {k: np.unique(np.concatenate(x)) for k, x in sorted(shingles.items())}

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, start, words, common weight, total weight) of the most similar window of each text and item."""
        words = Words(texts, lower=True)
        best: dict[tuple[int, int], tuple] = {}
        for k, shingles in self.shingles.items() if len(words) else ():
            grams, ok = words.grams(k), words.whole(k)
            at = np.minimum(np.searchsorted(shingles, grams), len(shingles) - 1)
            hit = ok & (shingles[at] == grams)
            hits = np.concatenate([[0], np.cumsum(hit)])
            for doc in np.unique(words.doc[hit]).tolist():
                lo, hi = int(words.first[doc]), int(words.first[doc + 1])
                for size, index in self.sizes.items():
                    if min(K, size) != k:
                        continue
                    least = SIMILAR * (size - k + 1)
                    if 100 * (hits[hi] - hits[lo]) < least:
                        break  # sizes ascend
                    window = min(size, hi - lo)
                    self.in_document(grams, hits, lo, hi, window, window - k + 1, least, index, best, doc)
        for (doc, item), (_, start, size, common, total) in sorted(best.items()):
            yield doc, item, start, size, common, total

    def in_document(self, grams: np.ndarray, hits: np.ndarray, lo: int, hi: int, size: int, span: int, least: int, index: MultiIndex, best: dict, doc: int) -> None:
        """Compare the windows of one size of one document with its candidates."""
        starts = np.arange(lo, hi - size + 1)
        starts = starts[100 * (hits[starts + span] - hits[starts]) >= least]
        while len(starts):
            some = starts[: np.searchsorted(starts, starts[0] + STRETCH)]
            prints = rolled(grams[some[0] : some[-1] + span], span)[some - some[0]]
            for w, item in index.candidates(prints):
                start, weights = int(some[w]), self.weights[item]
                own_total, most = weights.total(), int(hits[some[w] + span] - hits[some[w]])
                known = best.get((doc, item))
                if known and -known[0] >= most / (own_total + span - most):
                    continue  # no window with so few shingles of items is more similar
                own = Counter(grams[start : start + span].tolist())
                common = sum((own & weights).values())
                total = span + own_total - common
                if 100 * common >= SIMILAR * total:
                    found = (-common / total, start - lo, size, common, total)
                    best[doc, item] = min(best.get((doc, item), found), found)
            starts = starts[len(some) :]


def item_blocks(benchmark: DataFrame) -> Iterator[Index]:
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // ITEM_BYTES))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).distinct().orderBy("item_id", "text").collect()
        yield Index([r[0] for r in rows], [r[1] for r in rows])


_FOUND = "doc_id long, item_id long, start long, n_words long, similarity double"


def _reader(shared) -> Callable:
    @tidy
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[doc], index.ids[item], start, size, common / total) for doc, item, start, size, common, total in index.leaks(part.column("text"))]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.float64()), strict=True)], names=["doc_id", "item_id", "start", "n_words", "similarity"])

    return found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the most similar window of each document and item, from the threshold on."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return reduce(DataFrame.union, [rows.mapInArrow(_reader(context.broadcast(index)), _FOUND) for index in item_blocks(benchmark)])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    for index in item_blocks(benchmark):
        shared = context.broadcast(index)

        @tidy
        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    bad = {x[0] for x in shared.value.leaks(part.column("text"))}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_())) if bad else part

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
