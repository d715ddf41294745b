"""Operator 11: alignment of two tokenizers over every text, by exact-text deduplication.

Rows are dealt by their full text and counted, so each distinct text is tokenized and aligned once, however often it stands in the corpus; its pair counts are
weighted by that number, and its measures are joined back to all documents that have it.

Both tokenizers start anew at a space after a solid character, so a text is cut there into units, and a unit that a worker has met before is not encoded again.
A task's texts are gathered in runs of at most ``UNITS`` distinct units or ``BYTES`` of text (a longer text is a run of its own). A run keeps its texts as unit
numbers, and one list of the id pairs that its units link. Counts of pairs over the corpus are sums of these lists; each run is then sent the counts of its own pairs,
streamed in order before its texts, so no table of all pairs is ever held in one place.

Nulls: a null or empty text, or one whose tokens don't give back its bytes (such as those with U+2581), has no tokens: zeros, and '' as digest. Repeated rows are
returned each and count each. doc_id may be null and of any type. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import operator
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.llm.store import table, written
from fieldwise.llm.text import slices, tidy
from fieldwise.llm.token_output import SHOWN

#: Units that a worker remembers; distinct units and bytes of text of a run; new units that are encoded as one text.
REMEMBERED, UNITS, BYTES, TOGETHER = 500_000, 150_000, 16 << 20, 200
#: A space that may belong to what stands before it: after white space, control or format characters, or another space.
UNSURE = re.compile(r"[\s\x00-\x1f\x7f-\xa0\u00ad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff] ")
#: The last characters of units after which a space may not start anew, and no character.
UNSURE_ENDS = {"", *(c for c in map(chr, range(0x10000)) if UNSURE.match(c + " "))}
RUNS = "run long, text_key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, pairs array<long>, weights array<long>, starts binary, linked binary"
FIELDS = pa.schema([
    ("run", pa.int64()), ("text_key", pa.binary()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("units", pa.binary()),
    ("pairs", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())), ("starts", pa.binary()), ("linked", pa.binary()),
])
MEASURES = "text_key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def units(text: str) -> list[str]:
    """A space and the text, cut before each space that follows a solid character; every unit is given without its first space."""
    parts = text.split(" ")
    if not UNSURE.search(text) and text[0] != " " and text[-1] != " ":
        return parts
    out, open_ = [], False
    for i, part in enumerate(parts):
        if open_ or (out and part == "" and i == len(parts) - 1):
            out[-1] += " " + part
        else:
            out.append(part)
        open_ = part == "" or UNSURE.match(part[-1] + " ") is not None
    return out


def byte_level(path: str) -> tuple[dict[int, bytes], Callable[[list[str]], list[list[int]]]]:
    """The tokens of a byte-level tokenizer's file as bytes, and its encoder of texts, in which strings of special tokens are plain.

    Where the file has the usual cut into words and its ids stand in the order of its merges, the merges are done by the library made for such ranks, which is quicker on short texts; both give the same ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    of = {c: i for i, c in enumerate(SHOWN)}
    tokens = {i: bytes([of[c] for c in t]) for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in of for c in t)}
    rules = json.loads(tokenizer.to_str())
    cuts = rules["pre_tokenizer"] or {}
    model, ranks = rules["model"], {t: i for i, t in tokens.items()}
    merges = [x if isinstance(x, list) else x.split(" ") for x in model.get("merges", [])]
    ordered = [model["vocab"].get("".join(m)) for m in merges]
    if rules["normalizer"] is None and cuts.get("type") == "ByteLevel" and cuts.get("use_regex") and not cuts.get("add_prefix_space") and len(ranks) == len(merges) + 256 and None not in ordered and all(map(operator.lt, ordered, ordered[1:])):
        import tiktoken

        special = {x["id"] for x in rules["added_tokens"]}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if i not in special}, special_tokens={})
        return tokens, lambda texts: list(map(quick.encode_ordinary, texts))
    return tokens, lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Aligner:
    """Both tokenizers, and what is known of units, by their numbers: ``measures`` (n_a, n_b, n_groups, n_links), all zero if tokens don't give the unit back,
    the linked pairs and the groups as text, each with ";" behind, of one unit after the other."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor

        vocabulary, self.ids_a = byte_level(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        p = self.b
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.bytes_a = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.bytes_b = [bytes([int(x[3:-1], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in tokens]) for tokens in (self.bytes_a, self.bytes_b))
        ids = [str(i) for i in range(max(len(self.bytes_a), len(pieces)))]
        self.digits = np.array([len(x) for x in ids])
        self.said = {end: np.array([x + end for x in ids], object) for end in ",|;"}
        self.number: dict[str, int] = {}
        self._measures, self._pairs, self._groups = [np.zeros((0, 4), np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.large_string())]

    def known(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Measures, pairs and groups of all units that are known."""
        self._measures, self._pairs, self._groups = [np.concatenate(self._measures)], [np.concatenate(self._pairs)], [pa.concat_arrays(self._groups)]
        return self._measures[0], self._pairs[0], self._groups[0]

    def forget(self) -> None:
        """Drop the older half; the others get new numbers."""
        measures, pairs, groups = self.known()
        half = len(measures) // 2
        self.number = {u: i for i, u in enumerate(islice(self.number, half, None))}
        self._measures, self._pairs = [measures[half:].copy()], [pairs[measures[:half, 3].sum() :].copy()]
        self._groups = [groups.take(pa.array(np.arange(half, len(measures))))]

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of a space and each text, and whether they give back its bytes."""
        a, b = self.ids_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1)
        whole = [(" " + t).encode() for t in texts]
        return a, b, [b"".join(map(self.bytes_a.__getitem__, x)) == w == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, w in zip(a, b, whole, strict=True)]

    def learn(self, fresh: list[str]) -> None:
        """Units that end in a solid character are encoded in rows of ``TOGETHER``, as each starts anew; the others, and rows whose bytes don't come back, unit by unit."""
        solid = [u for u in fresh if u[-1:] not in UNSURE_ENDS]
        rows = [solid[i : i + TOGETHER] for i in range(0, len(solid), TOGETHER)]
        a, b, sound = self.encoded([" ".join(row) for row in rows])
        alone = [u for u in fresh if u[-1:] in UNSURE_ENDS] + [u for row, ok in zip(rows, sound, strict=True) if not ok for u in row]
        units, ids_a, ids_b = [u for row in compress(rows, sound) for u in row], list(compress(a, sound)), list(compress(b, sound))
        lost = []
        if alone:
            a, b, sound = self.encoded(alone)
            units, ids_a, ids_b = units + list(compress(alone, sound)), ids_a + list(compress(a, sound)), ids_b + list(compress(b, sound))
            lost = [u for u, ok in zip(alone, sound, strict=True) if not ok]
        if units:
            self.align(units, *(np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b)))
        if lost:
            self.number.update(zip(lost, range(len(self.number), len(self.number) + len(lost)), strict=True))
            self._measures.append(np.zeros((len(lost), 4), np.int64))
            self._groups.append(pa.array([""] * len(lost), pa.large_string()))

    def align(self, units: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Two token lists over the bytes of all units: every place where a token of either ends makes a link of the two tokens before it; where both end, a group ends."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.cumsum(pc.binary_length(pa.array(units, pa.string())).to_numpy().astype(np.int64) + 1)
        marks = np.zeros((3, ends[-1] + 1), bool)
        for mark, at in zip(marks, (ends_a, ends_b, ends), strict=True):
            mark[at] = True
        at = np.flatnonzero(marks[0] | marks[1])
        in_a, in_b, last = marks[:, at]
        both = in_a & in_b
        if np.count_nonzero(last & both) != len(units):
            raise ValueError("a token stands across two units")
        before = lambda mark: np.cumsum(mark) - mark
        unit, group = before(last), before(both)
        self._measures.append(np.stack([np.bincount(unit[mark], minlength=len(units)) for mark in (in_a, in_b, both)] + [np.bincount(unit)], axis=1))
        self._pairs.append((a[before(in_a)] << 32) | b[before(in_b)])
        # The ids in the order of the text: of each group those of A, then those of B.
        of_a, of_b = np.bincount(group[in_a]), np.bincount(group[in_b])
        place_a, place_b = np.arange(len(a)) + before(of_b)[group[in_a]], np.arange(len(b)) + np.cumsum(of_a)[group[in_b]]
        words, sizes = np.empty(len(a) + len(b), object), np.empty(len(a) + len(b), np.int64)
        words[place_a] = np.where(both[in_a], self.said["|"][a], self.said[","][a])
        words[place_b] = np.where(both[in_b], self.said[";"][b], self.said[","][b])
        sizes[place_a], sizes[place_b] = self.digits[a] + 1, self.digits[b] + 1
        offsets = np.concatenate([[0], np.cumsum(sizes)[np.cumsum(self._measures[-1][:, :2].sum(axis=1)) - 1]])
        self._groups.append(pa.Array.from_buffers(pa.large_string(), len(units), [None, pa.py_buffer(offsets), pa.py_buffer("".join(words.tolist()).encode())]))
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(*paths: str) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


class Run:
    """Texts of a task that share unit numbers and a list of pairs."""

    def __init__(self) -> None:
        self.rows: list[tuple[bytes, np.ndarray, int]] = []
        self.seen = np.zeros(0, bool)
        self.distinct = self.bytes = 0

    def add(self, key: bytes, own: np.ndarray, times: int, size: int, n_known: int) -> None:
        """own: numbers of the text's units; none if it has no tokens."""
        if len(self.seen) < n_known:
            self.seen = np.concatenate([self.seen, np.zeros(2 * n_known - len(self.seen), bool)])
        new = np.unique(own[~self.seen[own]])
        self.seen[new] = True
        self.distinct += len(new)
        self.rows.append((key, own, times))
        self.bytes += size

    def full(self) -> bool:
        return self.distinct > UNITS or self.bytes > BYTES

    def batches(self, run: int, both: Aligner, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
        """The run's pairs, then its texts, in batches of about ``most`` units."""
        if not self.rows:
            return
        measures, all_pairs, groups = both.known()
        used = np.flatnonzero(self.seen)
        local = np.zeros(len(measures), np.int32)
        local[used] = np.arange(len(used))
        sizes = np.array([len(own) for _, own, _ in self.rows])
        if len(used):
            n = measures[used, 3]
            starts = np.concatenate([[0], np.cumsum(n)])
            flat = all_pairs[np.repeat((np.cumsum(measures[:, 3]) - measures[:, 3])[used] - starts[:-1], n) + np.arange(starts[-1])]
            pairs, linked = np.unique(flat, return_inverse=True)
            # Each text's units count as often as the text stands in the corpus.
            weight = np.zeros(len(used), np.int64)
            np.add.at(weight, local[np.concatenate([own for _, own, _ in self.rows])], np.repeat([times for *_, times in self.rows], sizes))
            weights = np.zeros(len(pairs), np.int64)
            np.add.at(weights, linked, np.repeat(weight, n))
            one = {"run": [run], "pairs": [pairs], "weights": [weights], "starts": [starts.astype(np.int32).tobytes()], "linked": [linked.astype(np.int32).tobytes()]}
            yield pa.RecordBatch.from_arrays([pa.array(one.get(f.name, [None]), f.type) for f in FIELDS], schema=FIELDS)
        upto, at = np.cumsum(sizes), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
            rows = self.rows[at:to]
            flat = np.concatenate([own for _, own, _ in rows])
            edges = np.concatenate([[0], np.cumsum(sizes[at:to])])
            sums = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(measures[flat], axis=0)])[edges], axis=0)
            said = groups.take(pa.array(flat))
            text, ends = memoryview(said.buffers()[2] or b""), np.frombuffer(said.buffers()[1], np.int64)[edges].tolist()
            digests = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:], strict=False)]
            numbers = local[flat]
            columns = {"run": [run] * len(rows), "text_key": [r[0] for r in rows], "groups_sha256": digests, "units": [numbers[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)]}
            columns |= {c: sums[:, i] for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            yield pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(rows)), f.type) for f in FIELDS], schema=FIELDS)
            at = to


@tidy
def aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """(text_key, text, times) of distinct texts to rows of RUNS. Each different unit of some texts is looked up once, and those that are new in all of them are learnt together."""
    both, run, number = aligner(path_a, path_b), Run(), TaskContext.get().partitionId() << 32
    for part in (part for batch in batches for part in slices(batch)):
        keys, texts, times = part.columns
        lists = [units(t) for t in texts.to_pylist()]
        coded = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
        used = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [u for u in used if u not in both.number]
        if both.number and len(both.number) + len(fresh) > REMEMBERED:
            yield from run.batches(number, both)
            run, number = Run(), number + 1
            both.forget()
            fresh = [u for u in used if u not in both.number]
        if fresh:
            both.learn(fresh)
        own = np.array([both.number[u] for u in used])[coded.indices.to_numpy()]
        sound = both.known()[0][own, 3] > 0
        edges = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).tolist()
        sizes = pc.binary_length(texts).to_pylist()
        for key, n, size, lo, hi in zip(keys.to_pylist(), times.to_pylist(), sizes, edges, edges[1:], strict=False):
            run.add(key, own[lo : hi if sound[lo:hi].all() else lo], n, size, len(both.number))
            if run.full():
                yield from run.batches(number, both)
                run, number = Run(), number + 1
    yield from run.batches(number, both)


@tidy
def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of run and kind: the counts of a run's pairs (0), the pairs of its units (1), its texts (2); gives the measures of the texts."""
    counts: list[np.ndarray] = []
    bests: list[np.ndarray] = []
    per_unit = np.empty((0, 2), np.int64)
    for batch in batches:
        run, kind = batch.column("run").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((run[1:] != run[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(run)]]), strict=True):
            part = batch.slice(lo, hi - lo)
            if kind[lo] == 0:
                counts.append(part.column("n").to_numpy())
                bests.append(part.column("best").to_numpy())
            elif kind[lo] == 1:
                starts, linked = (np.frombuffer(part.column(c)[0].as_py(), np.int32) for c in ("starts", "linked"))
                own = np.stack([np.concatenate(bests), np.concatenate(counts)], axis=1)[linked]
                per_unit, counts, bests = np.add.reduceat(own, starts[:-1]), [], []
            else:
                sums = np.array([per_unit[np.frombuffer(x.as_py(), np.int32)].sum(axis=0) if len(x.as_py()) else (0, 0) for x in part.column("units")], np.int64).reshape(-1, 2)
                kept = {c: part.column(c) for c in ("text_key", "n_a", "n_b", "n_groups", "n_links")}
                yield pa.RecordBatch.from_pydict(kept | {"n_best": pa.array(sums[:, 0]), "count_sum": pa.array(sums[:, 1]), "groups_sha256": part.column("groups_sha256")})


def text_runs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Distinct texts of docs (text), tokenized and aligned once, as a table of RUNS."""
    texts = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("times")).select(F.unhex(F.sha2("text", 256)).alias("text_key"), "text", "times")
    return written(texts.mapInArrow(lambda it: aligned(it, path_a, path_b), RUNS), "aligned")


def pair_counts(runs: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus each id pair has, and whether no pair with that B id has more. A pair is ``(A id << 32) | B id``."""
    pairs = runs.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "weights")).alias("x"))
    counts = written(pairs.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.weights").alias("n")), "pairs")
    id_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # One row for each id of B's vocabulary at most.
    most = counts.groupBy(id_b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", id_b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    runs = text_runs(docs.select("text"), path_a, path_b)
    asked = runs.where("pairs is not null").select("run", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pair_counts(runs), "pair").select("run", F.lit(0).alias("kind"), "place", "n", "best")
    structure = runs.where("pairs is not null").select("run", F.lit(1).alias("kind"), "starts", "linked")
    texts = runs.where("text_key is not null").select("run", F.lit(2).alias("kind"), "text_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units")
    ordered = answers.unionByName(structure, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True).repartition("run").sortWithinPartitions("run", "kind", "place")
    measures = ordered.mapInArrow(measured, MEASURES)
    keyed = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_key"))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return keyed.join(measures, "text_key", "left").select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
