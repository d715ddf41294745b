"""Operator 10: toxicity by a lexicon trie intersected with Levenshtein automata, with context windows.

* Lexicon. Stems (4 to 6 characters) and words that stand in labelled toxic documents, and hardly in others, counted over all labelled
  training rows; nothing is listed by hand. A stem matches the beginning of a word.
* Misspellings. The frequent lexicon words stand in a trie; the states of their Levenshtein automata (one edit, or two
  from eight characters on) are pairs of trie node and edits. Sets of them are made into states of one machine when a text
  first needs them, so a word costs a step for each character until no term is near. Words near a term are judged as terms are, by the share
  of toxic ones among all labelled documents that have them: those below it are innocent and left alone, and a term is matched exactly only if its matches, weighed
  by documents and with an estimate of innocent words not seen yet, stay below it. Shares don't change as the labelled rows grow.
* Context. A hit inside quotation marks, or close to a word of reporting, is a quotation; the others are open. Address words nearby add to an open hit.
* Score. Logistic regression on the weights of open and quoted hits, learnt on the training rows.

Training rows are those with a label and ``crc32(doc_id) % 4 <> 2``; only their labels and texts are learnt from. Null or empty texts have no hits and the
score of a text without any. Rows with a null doc_id are never trained on. Repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.llm.store import if_small, table, written
from fieldwise.llm.text import slices

WORD = re.compile(r"[^\W_]+")
STEM = range(4, 7)
#: Least share of toxic documents with a term, of toxic ones among all that have it, and least share for misspellings.
SUPPORT, RATE, FUZZY_SUPPORT = 0.004, 0.9, 0.01
WINDOW, THRESHOLD = 8, 0.3
#: Words of reporting and of address, in the languages of the corpus.
REPORTING = frozenset("said says wrote writes quoted quote called dit disait écrit cité sagte schrieb zitierte nannte dijo escribió citó llamó".split())
ADDRESS = frozenset("you your du ihr dich tu vous ton usted tú".split())
OPENING = str.maketrans({"“": '"', "”": '"', "„": '"', "«": '"', "»": '"'})
REMEMBERED = 1_000_000


class Automaton:
    """Least edits between a word and the terms of a trie, up to each term's limit; states are made when first needed."""

    def __init__(self, terms: dict[str, int]):
        self.nodes: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.reach: list[int] = [0]
        for term, most in sorted(terms.items()):
            at = 0
            self.reach[0] = max(self.reach[0], most)
            for c in term:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                    self.reach.append(0)
                at = self.nodes[at][c]
                self.reach[at] = max(self.reach[at], most)
            self.ends[at] = most
        self.letters = {c for n in self.nodes for c in n}
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.found: list[int | None] = []
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        todo = list(edits)
        while todo:  # leaving out a letter of the term
            at = todo.pop()
            for to in self.nodes[at].values():
                if edits[at] + 1 <= self.reach[to] and edits[at] + 1 < edits.get(to, 99):
                    edits[to] = edits[at] + 1
                    todo.append(to)
        key = frozenset(edits.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.found.append(min((e for n, e in key if n in self.ends and e <= self.ends[n]), default=None))
        return self.ids[key]

    def step(self, state: int, c: str) -> int:
        c = c if c in self.letters else ""
        if (to := self.steps.get((state, c))) is None:
            edits: dict[int, int] = {}
            for at, e in self.states[state]:
                if e + 1 <= self.reach[at]:
                    edits[at] = min(e + 1, edits.get(at, 99))
                for letter, child in self.nodes[at].items():
                    cost = e + (letter != c)
                    if cost <= self.reach[child] and cost < edits.get(child, 99):
                        edits[child] = cost
            to = self.steps[state, c] = self._state(edits)
        return to

    def edits(self, word: str) -> int | None:
        state = self.start
        for c in word:
            state = self.step(state, c)
            if not self.states[state]:
                return None
        return self.found[state]


class Lexicon:
    def __init__(self, stems: list[str], words: list[str], innocent: frozenset[str] = frozenset()):
        self.stems, self.innocent = frozenset(stems), innocent
        self.automaton = Automaton({w: 1 + (len(w) >= 8) for w in words if len(w) >= 5})
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """1 for a term, less for each edit of a misspelt one, 0 for other words."""
        if (w := self.known.get(word)) is None:
            if any(word[:k] in self.stems for k in STEM) or word in self.stems:
                w = 1.0
            elif len(word) < 4 or word in self.innocent or (edits := self.automaton.edits(word)) is None:
                w = 0.0
            else:
                w = 0.8**edits
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[word] = w
        return w

    def hits(self, text: str | None) -> tuple[float, float]:
        """Weights of open and of quoted hits."""
        low = (text or "").lower()
        words = WORD.findall(low)
        known, weight = self.known, self.weight
        weights = [known[w] if w in known else weight(w) for w in words]
        if not any(weights):
            return 0.0, 0.0
        spans = [m.start() for m in WORD.finditer(low)]
        flat, opened, quoted = low.translate(OPENING), 0.0, 0.0
        for i, w in enumerate(weights):
            if w:
                line = flat.rfind("\n", 0, spans[i]) + 1
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                if flat.count('"', line, spans[i]) % 2 or not REPORTING.isdisjoint(near):
                    quoted += w
                else:
                    opened += w * (1.0 if ADDRESS.isdisjoint(near) else 1.5)
        return opened, quoted


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def terms_of(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return {w for w in words if len(w) >= 4} | {w[:k] for w in words for k in STEM if len(w) >= k}


def learn_lexicon(train: DataFrame) -> Lexicon:
    """train: (text, toxic), all labelled training rows. The counts cover all of them."""
    n_toxic = train.where("toxic = 1").count()
    least = max(5, int(SUPPORT * n_toxic))

    def in_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts: dict[str, int] = {}
                for text in part.column("text").to_pylist():
                    for t in terms_of(text):
                        counts[t] = counts.get(t, 0) + 1
                yield pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    toxic = train.where("toxic = 1").select("text").mapInArrow(in_toxic, "term string, n long").groupBy("term").agg(F.sum("n").alias("toxic")).where(F.col("toxic") >= least)
    # At most (terms of a document) / SUPPORT of them, whatever the corpus.
    support = {r["term"]: r["toxic"] for r in toxic.collect()}
    shared = train.sparkSession.sparkContext.broadcast(frozenset(support))

    def anywhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            counts: dict[str, int] = {}
            for text in part.column("text").to_pylist():
                for t in terms_of(text) & shared.value:
                    counts[t] = counts.get(t, 0) + 1
            yield pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    clean = {r["term"]: r["n"] for r in train.where("toxic = 0").select("text").mapInArrow(anywhere, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    good = {t: n for t, n in support.items() if n >= RATE * (n + clean.get(t, 0))}
    chosen = train.sparkSession.sparkContext.broadcast(frozenset(good))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            found: set[tuple[str, str]] = set()
            for text in part.column("text").to_pylist():
                words = ["", *WORD.findall((text or "").lower()), ""]
                for i in range(1, len(words) - 1):
                    for t in {words[i], *(words[i][:k] for k in STEM)} & chosen.value:
                        found.add((t, f"{words[i - 1]} {words[i + 1]}"))
            yield pa.RecordBatch.from_pydict({"term": pa.array([f[0] for f in found], pa.string()), "near": pa.array([f[1] for f in found], pa.string())})

    # Copies of one text repeat its words with their neighbours; a term must stand among as many different ones.
    apart = train.where("toxic = 1").select("text").mapInArrow(neighbours, "term string, near string").distinct().groupBy("term").count().where(F.col("count") >= least)
    good = {r["term"]: good[r["term"]] for r in apart.collect()}
    stems = [t for t in good if not any(t[:k] in good for k in STEM if k < len(t))]
    words = [t for t, n in good.items() if len(t) >= 5 and n >= FUZZY_SUPPORT * n_toxic and not any(t != o and o.startswith(t) and good[o] >= 0.9 * n for o in good)]
    first = train.sparkSession.sparkContext.broadcast(Lexicon(stems, words))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                for w in set(WORD.findall((text or "").lower())):
                    if 0 < first.value.weight(w) < 1:
                        counts.setdefault(w, [0, 0])[toxic == 1] += 1
            yield pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.string()), "clean": pa.array([c[0] for c in counts.values()], pa.int64()), "toxic": pa.array([c[1] for c in counts.values()], pa.int64())})

    # Words within the edits of a term in labelled documents; bounded by the automata, not by the corpus.
    found = train.where("toxic in (0, 1)").mapInArrow(near, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    innocent = frozenset(r["term"] for r in found if r["toxic"] < RATE * (r["toxic"] + r["clean"]))
    return Lexicon(stems, [w for w in words if clear(w, good[w], clean.get(w, 0), found)], innocent)


def clear(word: str, toxic: int, clean: int, found: list) -> bool:
    """Whether the documents that a term will match are toxic by the share that terms need. found: (term, clean, toxic) of near words.

    Innocent words match nothing; those of a single document stand for as many documents with words not seen yet (Good and Turing's estimate)."""
    own = Lexicon([], [word])
    for r in found:
        both = r["clean"] + r["toxic"]
        if (r["toxic"] >= RATE * both or both == 1) and own.weight(r["term"]) > 0:
            toxic, clean = toxic + r["toxic"], clean + r["clean"]
    return toxic >= RATE * (toxic + clean)


def features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            pairs = [shared.value.hits(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "opened": pa.array([p[0] for p in pairs], pa.float64()), "quoted": pa.array([p[1] for p in pairs], pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {kind}, opened double, quoted double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document. labels: (doc_id, toxic)."""
    known = written(labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "train_labels")
    known = if_small(known, known.count())
    found = written(features(docs, learn_lexicon(docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic"))), "features")
    inputs = [F.log1p("opened").alias("x1"), F.log1p("quoted").alias("x2"), (F.col("opened") > 0).cast("double").alias("x3")]
    rows = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="x").transform(found.select("doc_id", *inputs))
    train = rows.join(known, "doc_id").select("x", F.col("toxic").cast("double").alias("label"))
    if train.select("label").distinct().count() < 2:
        score = F.lit(0.0)
    else:
        fitted = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3, probabilityCol="p", predictionCol="y").fit(train)
        rows = fitted.transform(rows)
        score = vector_to_array("p")[1]
    rows = rows.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
