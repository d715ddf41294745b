"""Operator 4: exact Jaccard join of word n-gram sets, by prefix trees, and the components of its links.

A document's set is its distinct 5-word shingles. All sets are put in one global order of shingles: by fingerprint,
with those that a sample of the corpus shows to be frequent last, the most frequent at the very end. (Any order
gives the same links; the sample only keeps frequent shingles out of the prefixes.) Two sets with a Jaccard similarity of 0.75 or more
share one of their first ``n - ceil(0.75 n) + 1`` shingles, so:

1. ``signatures``: each document's set id and prefix. Documents with equal sets are one set from here on.
2. ``shared``: prefix shingles, dealt by shingle; those of one set alone can't link and go.
3. Guessing: in each of a few turns, each set asks at most one set of another component that the shingles' groups suggest,
   so the questions grow with the sets and not with the square of a group. They are answered on whole sets and the components of the links found.
4. The last round, which makes the result exact. Every group of a shingle that holds sets of several components is walked by a trie
   of the sets' next shared shingles in global order. The walk carries one overlap for all sets below a node, and a subtree is left as soon
   as the overlap and what either set has left can't reach the threshold. Of two sets, the one whose prefix ends first has all its common prefix
   shingles in the other's prefix too, so what it has left counts only its shared prefix shingles and those beyond its prefix; the other may have
   common ones that lie beyond the first one's prefix, so all its shingles count, by their places in the whole set.
   A smaller set whose prefix ends first has many shared shingles (it is dense) if it has a link; dense sets are stored in tries. Others only have links with larger
   sets whose prefixes end before theirs, of sizes that the larger one's bound leaves; they are stored by size. Sets of one component need not meet again.
5. What the walks leave is asked of blocks: a component's sets stand in blocks of about ``BLOCK`` sets, and a set of another component asks a whole block once, so
   a set that is near a component without a link to it costs a row for each block and not one for each member. Questions are put to bitmaps first: each set has one, in which
   every shingle flips a bit, so two sets differ in at least as many shingles as their bitmaps do in bits. Those left go to whole sets: a block is a trie of them, in which
   overlaps are exact; a question ends at the block's first link, as all its sets are of one component.

A shingle's group of more than ``GROUP`` sets is dealt out in chunks: sets of its main component are each in one chunk, the others in all of them.

Results: a null or empty text has an empty set, linked with nothing. Rows with a null doc_id take no part in links (component null).
Repeated rows are returned each. A doc_id with two texts links as both. Columns besides doc_id and text are ignored. Set ids and shingles are 64-bit fingerprints.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwise.llm.store import dropped, give_back_driver, if_small, shuffle_partitions, small_batches, table, written, written_and_counted
from fieldwise.llm.text import U64, Words, mix, shingle_sets, slices, tidy

K = 5
#: Documents of which the order of shingles is learnt, shingles that it may set apart, and the repeats that do so.
ORDER_SAMPLE, MOST_FREQUENT, FREQUENT_FROM = 4000, 1 << 16, 4
#: Shared shingles of a set that its entry in a trie spells out; the rest is counted.
AHEAD = 6
#: Rounds of guessing before the exact one, and shared shingles of a set that guess.
TURNS, VOTES = 3, 16
#: Sets of a block, questions that one copy of a block answers, and sets of a shingle's group that are walked together.
BLOCK, ASKED, GROUP = 64, 2048, 2048


def set_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values ^ U64(0x5851F42D4C957F2D)))])
    return mix((total[at[1:]] - total[at[:-1]]) + np.diff(at).astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


@tidy
def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, text) to (sid, shingles) of the texts that have the set of their row."""
    for batch in batches:
        for part in slices(batch):
            values, at = shingle_sets(Words(part.column("text"), lower=True), K)
            sid = set_ids(values, at)
            own = pa.array(sid == part.column("sid").to_numpy())
            yield pa.RecordBatch.from_pydict({"sid": pa.array(sid), "shingles": lists(values, at)}).filter(own)


def bitmaps(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each set the bits that its shingles flip, of at least two bits a shingle: a power of two of them, so that a longer bitmap folds to a shorter one."""
    n = np.diff(at)
    width = np.where(n > 0, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64)), 0)
    edges = np.concatenate([[0], np.cumsum(width)])
    bit = (mix(values ^ U64(0x9FB21C651E98DF25)) & np.repeat(width - 1, n).astype(U64)).astype(np.int64) + np.repeat(edges[:-1], n)
    flipped = np.packbits((np.bincount(bit, minlength=edges[-1]) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((edges // 8).astype(np.int32).tobytes()), pa.py_buffer(flipped.tobytes())])


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps, one a row of 64-bit words, folded to ``width`` words."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


@tidy
def signatures(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, sid, n, prefix, bits); the prefix in global order."""
    for batch in batches:
        for part in slices(batch):
            values, at = shingle_sets(Words(part.column("text"), lower=True), K)
            n, sid, bits = np.diff(at), set_ids(values, at), bitmaps(values, at)
            if len(frequent):
                i = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                late = np.where(frequent[i] == values, rank[i] + 1, 0)
                values = values[np.lexsort((late, np.repeat(np.arange(len(n)), n)))]
            size = np.where(n > 0, n - (3 * n + 3) // 4 + 1, 0)
            to = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(at[:-1] - to[:-1], size) + np.arange(to[-1])
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "sid": pa.array(sid), "n": pa.array(n.astype(np.int32)), "prefix": lists(values[take], to), "bits": bits})


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a bounded sample of documents has often, sorted, and their rank by frequency."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    n = rows.select("doc_id").count()
    share = min(1_000_000, max(1, ORDER_SAMPLE * 1_000_000 // max(n, 1)))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(1_000_000)) < share).limit(2 * ORDER_SAMPLE)

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, times = np.unique(shingle_sets(Words(part.column("text"), lower=True), K)[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(values.view(np.int64)), "n": pa.array(times.astype(np.int64))})

    found = picked.repartition(4).mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).collect()
    values = np.array([r["shingle"] for r in reversed(top)], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], order.astype(np.int64)


@tidy
def only_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, sid, ...) in order, all of a shingle in one partition, to one row for each shingle and set; shingles with one set alone are left out."""
    last, mated = None, False
    for batch in batches:
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        shingle, sid = (rows.column(c).to_numpy() for c in ("shingle", "sid"))
        if not len(sid):
            continue
        fresh = np.ones(len(sid), bool)
        fresh[1:] = (shingle[1:] != shingle[:-1]) | (sid[1:] != sid[:-1])
        at = np.flatnonzero(fresh)
        of = shingle[at]
        before = np.ones(len(at), bool)
        before[0], before[1:] = mated, of[1:] == of[:-1]
        keep = before.copy()
        keep[:-1] |= before[1:]
        last, mated = rows.slice(int(at[-1]), 1), bool(before[-1])
        yield rows.take(pa.array(at[:-1][keep[:-1]]))
    if mated:
        yield last


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(id, root) for every id on an edge (a, b), and the number of edges between different ids; the root is the least id of its component. Alternates large and small stars."""

    def starred(e: DataFrame, small: bool) -> DataFrame:
        if small:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = both.join(least, "u")
        if small:
            out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        else:
            out = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def ended(e: DataFrame) -> bool:
        """Whether only stars are left: no id points at two others, none that points at one is pointed at."""
        ends = e.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("id").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or out > 0 and into > 0").count() == 0

    edges, n = written_and_counted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while n > 1 and not ended(edges):
        edges = written(starred(starred(edges, small=False), small=True), "stars")
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct()), n


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, root) after more links (a, b): only the graph of the roots that the new links touch is searched, not all links so far."""
    if roots is None:
        return written(components(links)[0], "components")
    of = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved, edges = components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    if not edges:
        return roots
    moved, n = written_and_counted(moved, "moved")
    changed = roots.join(if_small(moved.select(F.col("id").alias("root"), F.col("root").alias("new")), n), "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    # Roots point at themselves, so ids that are no one's yet are those without a row.
    return written(changed.union(moved.join(roots.select("id"), "id", "left_anti").select("id", "root")), "components")


class Entry(NamedTuple):
    """A set in a shingle's group. The keys are its next shared shingles in global order, from the group's own on; ``after`` counts those that come later and all
    shingles beyond the prefix; ``before`` are the shared ones just before. ``places`` are the keys' places in the whole ordered set and ``last`` is the last
    shingle of the whole prefix; where a group doesn't give them, only bounds hold that don't need them. ``weight`` is the size of its component and ``block`` the part of it that it stands in."""

    sid: int
    n: int
    label: int
    dense: bool
    keys: list
    after: int
    before: frozenset
    places: list | tuple = ()
    last: Any = None
    weight: int = 0
    block: int = 0

    def shared(self, i: int) -> int:
        """Shingles after the first i keys that may be common with a set whose prefix doesn't end before this one's."""
        return len(self.keys) - i + self.after

    def whole(self, i: int) -> int:
        """All shingles after the first i keys."""
        return self.n - self.places[i - 1] - 1 if i and self.places else self.n - i

    def ends_first(self, other: Entry) -> bool:
        return self.last is not None and other.last is not None and self.last <= other.last


class Node:
    __slots__ = ("children", "sets", "least_n", "most_shared", "most_whole", "label")

    def __init__(self) -> None:
        self.children: dict[tuple, Node] = {}
        self.sets: list[Entry] = []
        self.least_n, self.most_shared, self.most_whole, self.label = 1 << 60, -1, -1, None


def needed(n: int, m: int) -> int:
    """Least overlap of sets of n and m with a Jaccard similarity of 0.75: 100 * o >= 75 * (n + m - o)."""
    return (3 * (n + m) + 6) // 7


def trie_pairs(members: list[tuple]) -> Iterator[tuple[Entry, Entry]]:
    """Pairs of different labels that may reach the threshold, of sets (fields of ``Entry``) that have the first key in common; the smaller set first.

    Sets with a common key among the ones just before have met in that key's group."""
    root, sparse, sizes = Node(), [], []
    for e in sorted((Entry(*m) for m in members), key=lambda m: (m.n, m.sid)):
        n, keys, label = e.n, e.keys, e.label
        stack = [(root, 0, 0, 0, n)]
        while stack:
            node, i, overlap, unseen, its_whole = stack.pop()
            shared, whole = e.shared(i), e.whole(i)
            for o in node.sets:
                if o.label != label and 4 * o.n >= 3 * n:
                    left = shared if e.ends_first(o) else whole
                    its_left = o.after + unseen if o.ends_first(e) else its_whole if unseen else o.whole(len(o.keys))
                    if overlap + min(left, its_left) >= needed(n, o.n) and e.before.isdisjoint(o.before):
                        yield o, e
            for key, child in node.children.items():
                if child.label == label:
                    continue
                j = i
                while j < len(keys) and keys[j] < key:
                    j += 1
                hit = j < len(keys) and keys[j] == key
                now = overlap + hit
                # Keys of the path beyond those that this entry spells out may be common too, and so may all after the last one that it does.
                more, most_whole = (unseen, child.most_whole) if j < len(keys) else (unseen + 1, its_whole)
                at = j + hit
                # Either of the two may be the one whose prefix ends first.
                left = min(e.whole(at), most_whole) if e.last is None else max(min(e.shared(at), most_whole), min(e.whole(at), child.most_shared + more))
                if now + left >= needed(n, max(child.least_n, (3 * n + 3) // 4)):
                    stack.append((child, at, now, more, most_whole))
        least = (3 * n + 3) // 4
        # The sizes up to which this set, as the one that ends first, has enough left.
        most = 7 * (n if e.last is None else e.shared(0)) // 3 - n
        for o in sparse[bisect_left(sizes, least) : bisect_right(sizes, most)]:
            if o.label != label and (e.last is None or e.last < o.last) and e.before.isdisjoint(o.before) and may_link(e, o):
                yield o, e
        if e.dense:
            node = root
            for depth, key in enumerate(keys, 1):
                node = node.children.setdefault(key, Node())
                node.label = label if node.label in (None, label) else -1
                node.least_n = min(node.least_n, n)
                node.most_shared, node.most_whole = max(node.most_shared, e.shared(depth)), max(node.most_whole, e.whole(depth))
            node.sets.append(e)
        elif 1 + e.whole(1) >= needed(n, n):
            sparse.append(e)
            sizes.append(n)


def may_link(e: Entry, o: Entry) -> bool:
    """Whether two sets may reach the threshold by the keys that they spell out."""
    i = j = overlap = 0
    while i < len(e.keys) and j < len(o.keys):
        x, y = e.keys[i], o.keys[j]
        overlap += x == y
        i, j = i + (x <= y), j + (y <= x)
    left = e.shared(i) if e.ends_first(o) else e.whole(i)
    its_left = o.shared(j) if o.ends_first(e) else o.whole(j)
    return overlap + min(left, its_left) >= needed(e.n, o.n)


@tidy
def tried(batches: Iterator[pa.RecordBatch], ranks: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows in order of shingle and chunk, all of a chunk in one partition, to questions (sid, block): of two sets, the one of the smaller component asks the other's block."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def key(shingle: int) -> tuple[int, int]:
        return ranks.get(shingle, 0), shingle % (1 << 64)

    found: set[tuple[int, int]] = set()
    for _, group in groupby(rows(), key=lambda r: r[:2]):
        members = [(sid, n, root, dense, [key(k) for k in keys], after, frozenset(before), places, key(last), weight, block) for _, _, sid, n, root, dense, keys, after, before, places, last, weight, block in group]
        for o, e in trie_pairs(members):
            found.add((o.sid, e.block) if (o.weight, o.label) < (e.weight, e.label) else (e.sid, o.block))
            if len(found) > 100_000:
                yield as_pairs(found)
                found = set()
    yield as_pairs(found)


def as_pairs(found: set[tuple[int, int]], names: tuple[str, str] = ("sid", "block")) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array([p[i] for p in found], pa.int64()) for i, name in enumerate(names)})


@tidy
def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, asks, sid, n, bits) in order, a block's own sets before those that ask, to the questions (sid, block) of sets that may link with one of the block by their bitmaps.

    Sets of n and m with a link differ in (n + m) / 7 shingles at most, and the smaller has 0.75 of the larger's."""
    at, own, stacks, found = None, {}, {}, []
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("block", "part", "asks", "sid", "n", "bits")), strict=True)
        for block, part, asks, sid, n, raw in rows:
            if (block, part) != at:
                at, own, stacks = (block, part), {}, {}
            bits = np.frombuffer(raw, np.uint64)
            if not asks:
                own.setdefault(len(bits), []).append((n, bits))
                continue
            for width, sets in own.items():
                least = min(width, len(bits))
                if (width, least) not in stacks:
                    stacks[width, least] = folded(np.stack([x for _, x in sets]), least), np.array([m for m, _ in sets])
                maps, sizes = stacks[width, least]
                near = 7 * np.bitwise_count(maps ^ folded(bits, least)).sum(1, dtype=np.int64) <= sizes + n
                if (near & (4 * np.minimum(sizes, n) >= 3 * np.maximum(sizes, n))).any():
                    found.append((sid, block))
                    break
        yield as_pairs(found)
        found = []


class Whole:
    """A node of a block's trie: the shingles on the way from its parent, the sets that end here, as (sid, size), and the size of the largest set at or below it."""

    __slots__ = ("keys", "ends", "children", "most")

    def __init__(self, members: list[tuple[list, int]], shingles: list, depth: int = 0):
        """members: (ranks, sid) in order of ranks; shingles: by rank."""
        first, last, to = members[0][0], members[-1][0], depth
        while to < len(first) and to < len(last) and first[to] == last[to]:
            to += 1
        self.keys = frozenset([shingles[r] for r in first[depth:to]])
        self.most = max(len(ranks) for ranks, _ in members)
        self.ends = [(sid, to) for ranks, sid in members if len(ranks) == to]
        self.children = [Whole(list(own), shingles, to) for _, own in groupby(members[len(self.ends) :], key=lambda m: m[0][to])]

    def links(self, own: set) -> Iterator[int]:
        """Sets that link with the given one. A subtree is left when more of its shingles are missing than its largest set may miss."""
        n, stack = 3 * len(own), [(self, 0)]
        while stack:
            node, missing = stack.pop()
            missing += len(node.keys) - len(node.keys & own)
            if 7 * missing <= 4 * node.most - n:
                for sid, size in node.ends:
                    if 7 * missing <= 4 * size - n:  # 100 * overlap >= 75 * union
                        yield sid
                stack += [(child, missing) for child in node.children]


def whole_trie(sets: dict[int, list]) -> Whole:
    """The trie of a block's sets; the order of shingles is the block's own, the ones that most sets have first."""
    times = Counter(chain.from_iterable(sets.values()))
    shingles = sorted(times, key=lambda x: (-times[x], x))
    rank = {x: i for i, x in enumerate(shingles)}
    return Whole(sorted((sorted([rank[x] for x in own]), sid) for sid, own in sets.items()), shingles)


@tidy
def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, asks, sid, shingles) in order, a block's own sets before those that ask, to links: the first one of each question."""
    at, sets, trie, found = None, {}, None, []
    for batch in batches:
        values, offsets = batch.column("shingles").values.to_numpy(), batch.column("shingles").offsets.to_numpy()
        for i, (block, part, asks, sid) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "part", "asks", "sid")), strict=True)):
            own = values[offsets[i] : offsets[i + 1]].tolist()
            if (block, part) != at:
                at, sets, trie = (block, part), {}, None
            if not asks:
                sets[sid] = own
            elif sets:
                trie = trie or whole_trie(sets)
                if (link := next(trie.links(set(own)), None)) is not None:
                    found.append((sid, link))
        yield as_pairs(found, ("a", "b"))
        found = []


def hot_groups(rows: DataFrame) -> DataFrame:
    """(shingle, chunks) of the shingles with more than ``GROUP`` rows, so at most one row for each ``GROUP``."""
    many = rows.groupBy("shingle").count().where(F.col("count") > GROUP)
    return many.select("shingle", F.ceil(F.col("count") / GROUP).cast("int").alias("chunks"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text")
    frequent, rank = frequent_shingles(texts)
    sig = written(texts.mapInArrow(lambda it: signatures(it, frequent, rank), "doc_id long, sid long, n int, prefix array<long>, bits binary"), "signatures")

    linkable = sig.where("n > 0 and doc_id is not null")
    sets = linkable.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first(F.element_at("prefix", -1)).alias("last"), F.first("bits").alias("bits"))
    sets = written(sets, "sets")
    give_back_driver(spark)
    repeated = bool(linkable.groupBy("doc_id", "sid").count().where("count > 1").take(1))
    corpus = Corpus(texts, sets, repeated)
    several = sets.where("copies > 1").select("sid", "rep")
    alone = linkable.join(if_small(several, several.count()), "sid", "left").where("rep is null or rep = doc_id")
    postings = alone.select("sid", "n", F.posexplode("prefix").alias("place", "shingle")).select("shingle", "sid", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("place")).alias("n_place"))
    shared = postings.repartition(shuffle_partitions(spark), "shingle").sortWithinPartitions("shingle", "sid").mapInArrow(only_shared, postings.schema)
    shared = written(shared.select("shingle", "sid", F.shiftright("n_place", 32).cast("int").alias("n"), F.col("n_place").bitwiseAND((1 << 32) - 1).cast("int").alias("place")), "shared")
    hot, n = written_and_counted(hot_groups(shared), "hot")
    hot = F.broadcast(hot) if n else None

    roots = None
    for turn in range(TURNS):
        asks, n = written_and_counted(guesses(shared, hot, roots, turn), "asks")
        roots = joined(roots, links(corpus, asks, Blocks(n)))
        give_back_driver(spark)

    labelled = shared.join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = labelled.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    open_ = written(labelled.join(mixed, "shingle"), "open")
    prefix = F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1
    beyond = F.col("n") - prefix
    enough = F.floor((6 * F.col("n") + 6) / 7)
    own = open_.groupBy("sid").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("place", "shingle"))).alias("items"))
    own = written(own.join(sets.select("sid", "last"), "sid"), "own")
    weights, n = written_and_counted(own.groupBy("root").agg(F.count(F.lit(1)).alias("weight")), "weights")
    block = F.xxhash64("root", F.pmod(F.xxhash64("sid"), F.ceil(F.col("weight") / BLOCK)))
    own = own.join(if_small(weights, n), "root").withColumn("block", block)
    entries = own.select("sid", "n", "root", "last", "weight", "block", (F.size("items") + beyond >= enough).alias("dense"), beyond.alias("beyond"), F.col("items")["shingle"].alias("keys"), F.col("items")["place"].alias("places"))
    entries = entries.select("*", F.posexplode("keys").alias("i", "shingle"))
    after = F.greatest(F.size("keys") - F.col("i") - AHEAD, F.lit(0)) + F.col("beyond")
    just_before = F.slice("keys", F.greatest(F.col("i") - AHEAD, F.lit(0)) + 1, F.least(F.col("i"), F.lit(AHEAD)))
    next_ = lambda c: F.slice(c, F.col("i") + 1, AHEAD).alias(c)
    entries = entries.select("shingle", "sid", "n", "root", "dense", next_("keys"), after.alias("after"), just_before.alias("before"), next_("places"), "last", "weight", "block")
    if hot is None:
        entries = entries.withColumn("chunk", F.lit(0))
    else:
        sizes = open_.join(hot, "shingle").groupBy("shingle", "root", "chunks").count()
        main = written(sizes.groupBy("shingle", "chunks").agg(F.max_by("root", F.struct("count", "root")).alias("main")), "main")
        entries = entries.join(F.broadcast(main), "shingle", "left")
        every = F.sequence(F.lit(0), F.col("chunks") - 1)
        chunk = F.when(F.col("main").isNull(), F.array(F.lit(0))).when(F.col("root") == F.col("main"), F.array(F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))).otherwise(every)
        entries = entries.withColumn("chunk", F.explode(chunk))
    entries = entries.select("shingle", "chunk", "sid", "n", "root", "dense", "keys", "after", "before", "places", "last", "weight", "block")
    ranks = dict(zip(frequent.view(np.int64).tolist(), (rank + 1).tolist(), strict=True))
    dealt = entries.repartition(shuffle_partitions(spark), "shingle", "chunk").sortWithinPartitions("shingle", "chunk")
    asks, n = written_and_counted(dealt.mapInArrow(lambda it: tried(it, ranks), "sid long, block long").distinct(), "asks")
    roots = joined(roots, links(corpus, asks, Blocks(n, own.select("sid", "block"))))
    give_back_driver(spark)

    known = sets.select("sid", "rep").join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_set = known.join(least, "root").select("sid", "component_id")
    out = linkable.join(by_set, "sid").select("doc_id", "sid", "n", "component_id")
    out = out.union(sig.where("not (n > 0 and doc_id is not null)").select("doc_id", "sid", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "sid", F.col("n").cast("long").alias("n_shingles"), "component_id")


def guesses(shared: DataFrame, hot: DataFrame | None, roots: DataFrame | None, turn: int) -> DataFrame:
    """Questions (sid, block), a block being one set: each set asks at most one other, of another component, with which it shares most groups as a neighbour.

    Of large sets, only shingles of every second, fourth... hash count here, about ``VOTES`` a set; sets of about one size see the same ones. Neighbours are those next to it by size at first, then by a hash
    that changes with the turn; a hot shingle's group is searched in parts. The rows don't exceed the sets."""
    step = lambda n: F.greatest(F.lit(1.0), F.pow(2.0, F.floor(F.log2(n / (4 * VOTES))))).cast("long")
    some = shared.select("shingle", "sid", "n").where(F.pmod(F.xxhash64("shingle", F.lit("vote")), step(F.col("n"))) == 0)
    if hot is None:
        rows = some.withColumn("part", F.lit(0).cast("long"))
    else:
        part = F.coalesce(F.pmod(F.xxhash64("sid", F.lit(turn), F.lit("part")), F.col("chunks")), F.lit(0))
        rows = some.join(hot, "shingle", "left").select("shingle", "sid", "n", part.alias("part"))
    if roots is None:
        rows, order = rows.withColumn("root", F.col("sid")), Window.partitionBy("shingle", "part").orderBy("n", "sid")
    else:
        rows = rows.join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        order = Window.partitionBy("shingle", "part").orderBy(F.xxhash64("sid", F.lit(turn)), "sid")
    own = F.struct(F.col("sid").alias("a"), F.col("n").alias("m"), F.col("root").alias("r"))
    near = rows.select("sid", "n", "root", F.array(F.lag(own).over(order), F.first(own).over(order)).alias("near"))
    near = near.select("sid", "n", "root", F.explode("near").alias("x")).where("x.r <> root and 4 * least(x.m, n) >= 3 * greatest(x.m, n)")
    votes = near.groupBy("sid", F.col("x.a").alias("a")).agg(F.count(F.lit(1)).alias("votes"), F.least(F.first("n"), F.first("x.m")).alias("n"))
    # A pair with few common prefix shingles for its size is left to the last round.
    return votes.where(20 * F.col("votes") * step(F.col("n")) >= F.col("n")).groupBy("sid").agg(F.max_by("a", F.struct("votes", "a")).alias("block")).select("sid", "block")


class Corpus(NamedTuple):
    """texts: (doc_id, text); sets: one row a set, with the least doc_id that has it and its bitmap; repeated: whether rows repeat a doc_id and a set."""

    texts: DataFrame
    sets: DataFrame
    repeated: bool


class Blocks(NamedTuple):
    """n_asks: how many questions there are; sets: (sid, block), or None where a block is the one set of its name."""

    n_asks: int
    sets: DataFrame | None = None


def of_blocks(rows: DataFrame, asks: DataFrame, members: DataFrame, n_parts: DataFrame | None, content: list[str]) -> DataFrame:
    """Rows (sid, content...) of members and of those that ask, dealt by block and part, a block's members first. A block that many ask is copied, one copy for each ``ASKED`` of them."""
    if n_parts is None:
        part = own = F.lit(0)
    else:
        members, asks = members.join(n_parts, "block", "left"), asks.join(n_parts, "block", "left")
        parts = F.coalesce("parts", F.lit(1))
        part, own = F.explode(F.sequence(F.lit(0), parts - 1)), F.pmod(F.xxhash64("sid"), parts).cast("int")
    stored = rows.join(members, "sid").select("block", part.alias("part"), F.lit(False).alias("asks"), "sid", *content)
    asking = rows.join(asks, "sid").select("block", own.alias("part"), F.lit(True).alias("asks"), "sid", *content)
    return stored.union(asking).repartition(shuffle_partitions(rows.sparkSession), "block", "part").sortWithinPartitions("block", "part", "asks")


def parts_of(asks: DataFrame, n: int) -> DataFrame | None:
    """(block, parts) of the blocks that more than ``ASKED`` of the n questions ask, so at most one row for each ``ASKED`` questions; None if there are no such blocks."""
    if n <= ASKED:
        return None
    many = asks.groupBy("block").count().where(F.col("count") > ASKED)
    parts, n = written_and_counted(many.select("block", F.ceil(F.col("count") / ASKED).cast("int").alias("parts")), "parts")
    return F.broadcast(parts) if n else None


def links(corpus: Corpus, asks: DataFrame, blocks: Blocks) -> DataFrame:
    """Links (a, b) of the sets that ask, (sid, block), with the sets of the blocks; both are tables.

    Whole sets are only made for documents whose bitmaps leave a question open. Each query leaves its plan with the driver, so none is made for what nobody asks."""
    spark = corpus.texts.sparkSession

    def asked() -> DataFrame:
        names = asks.select("block").distinct()
        return names.select("block", F.col("block").alias("sid")) if blocks.sets is None else blocks.sets.join(names, "block", "left_semi")

    none = spark.createDataFrame([], "a long, b long")
    if not blocks.n_asks:
        return none
    prints = corpus.sets.select("sid", "n", "bits")
    asks, n = written_and_counted(of_blocks(prints, asks, asked(), parts_of(asks, blocks.n_asks), ["n", "bits"]).mapInArrow(likely, "sid long, block long").distinct(), "asks")
    if not n:
        return none

    members = asked()
    # The sets of either side, each with one document.
    wanted, m = written_and_counted(asks.select("sid").union(members.select("sid")).distinct().join(corpus.sets, "sid").select("sid", F.col("rep").alias("doc_id")), "wanted")
    texts = corpus.texts.join(if_small(wanted, m), "doc_id").select("sid", "text")
    found = texts.mapInArrow(sets_of, "sid long, shingles array<long>")
    found = written(found.dropDuplicates(["sid"]) if corpus.repeated else found, "whole")
    out = written(of_blocks(found, asks, members, parts_of(asks, n), ["shingles"]).mapInArrow(answered, "a long, b long"), "links")
    dropped(spark, found)
    return out


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the least doc_id; documents without a set or an id stay too.

    Of rows that repeat a doc_id and a text one stays; other texts of that id stay beside it."""
    found = written(near_copies(docs).select("doc_id", "component_id"), "components")
    gone, n = written_and_counted(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(if_small(gone, n), "doc_id", "left_anti").select(docs.columns)
    again, n = written_and_counted(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not n:
        return kept
    again = if_small(again, n)
    once = kept.join(again, "doc_id", "left_semi").withColumn("_op4_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_op4_text"]).select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(once)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Links of texts by their shingles, then the closure of the links. Shingles of one set alone make no pairs.
OP4_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as s from w where len(ws) > 0),
g as (select distinct doc_id, md5(array_to_string(ws[s:s+4], ' ')) as g from p),
c as (select doc_id, count(*) as n, md5(string_agg(g, '' order by g)) as k from g group by doc_id),
r as (select k, min(doc_id) as rep, min(n) as n from c group by k),
h as (select g.* from g join r on g.doc_id = r.rep),
l as (select x.a, x.b from (select a.doc_id as a, b.doc_id as b, count(*) as o from h a join h b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2) x
  join r ra on x.a = ra.rep join r rb on x.b = rb.rep where 100 * o >= 75 * (ra.n + rb.n - o)),
e as (select a, b from l union all select b, a from l),
t(id, reached) as (select rep, rep from r union select t.id, e.b from t join e on t.reached = e.a),
m as (select id, min(reached) as component_id from t group by id)
select w.doc_id, cast(coalesce(c.n, 0) as bigint) as n_shingles, coalesce(m.component_id, w.doc_id) as component_id
from w left join c on w.doc_id = c.doc_id left join r on c.k = r.k left join m on r.rep = m.id
"""
