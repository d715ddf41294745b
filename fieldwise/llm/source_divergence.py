"""Operator 13: how far the sources of a language differ in their terms, by chunk factorization.

Documents are cut at white space. Each task counts its chunks, by language and source, and names up to nine documents of each chunk (ten are enough to know
that its terms stay). Rows are then dealt by chunk alone, so that every distinct chunk of the corpus meets in one place and is tokenized there once; its counts
and documents go on to its terms, are summed up by chunk task, dealt by term and joined. A chunk or a term has one row for each task and language
(more only where a task's memory was full), so frequent ones stay small. No list of documents grows beyond nine.

The measures: with counts smoothed by 2 and scaled to 1,000,000,000 as whole numbers, a term's part in the distance of two sources is
``floor((p - q)^2 / (p + q))``. Part ``pair`` has the sum over all kept terms for each two sources of a language, part ``term`` a source's most
characteristic terms against its whole language.

Nulls: a null text, lang or source is ''. A row is a document, whatever its doc_id, so repeated rows count each. Texts without terms still make their group occur.
Ties rank by item. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwise.llm.store import if_small, table, written
from fieldwise.llm.text import Words, slices

#: Documents of a language that a term needs, ranks of part ``term``, the scale of shares and the smoothing: fixed values of the contract.
SUPPORT, TOP, SCALE, SMOOTH = 10, 10, 1_000_000_000, 2
#: Entries that a task sums up before it hands them on, rows of a batch, bits of a language's number within a task, and entries of distances that a task keeps.
HELD, ROWS_OUT, LANG_BITS, DISTANCES = 2_000_000, 20_000, 20, 4_000_000
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ROWS = pa.schema([("lang", pa.string()), ("item", pa.string()), ("sources", pa.list_(pa.string())), ("numbers", pa.list_(pa.int64()))])
#: numbers: the occurrences by source, then the documents; an item with enough documents names none. One list takes fewer bytes than two.
SCHEMA = "lang string, item string, sources array<string>, numbers array<long>"


class Codes(dict):
    """Numbers of values in the order of their first place."""

    def of(self, values: pa.Array) -> np.ndarray:
        coded = values.dictionary_encode()
        own = np.array([self.setdefault(v, len(self)) for v in coded.dictionary.to_pylist()], np.int64)
        return own[coded.indices.to_numpy()] if len(own) else np.empty(0, np.int64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change, the first place included."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    change = np.ones(len(keys[0]), bool)
    change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(change)


def lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """Runs of values, from each start to the next, as lists."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


class Counts:
    """Sums of occurrences by item, language and source, and up to nine documents of an item and language, as arrays.

    key: item and language in one number; items, langs and sources are numbered in the order of their first place."""

    def __init__(self) -> None:
        self.items, self.langs, self.sources = Codes(), Codes(), Codes()
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.enough: list[np.ndarray] = []
        self.held = 0

    def add(self, key: np.ndarray, source: np.ndarray, n: np.ndarray, doc_key: np.ndarray, doc: np.ndarray, enough: np.ndarray) -> None:
        self.entries.append((key, source, n))
        self.docs.append((doc_key, doc))
        self.enough.append(enough)
        self.held += len(key) + len(doc)

    def sum_up(self) -> None:
        """One entry for each key and source, and one for each key and document of keys that have too few of them."""
        if not self.entries:
            return
        key, source, n = (np.concatenate(x) for x in zip(*self.entries, strict=True))
        self.entries = []
        order = np.lexsort((source, key))
        key, source, n = key[order], source[order], n[order]
        at = runs(key, source)
        self.entries = [(key[at], source[at], np.add.reduceat(n, at) if len(at) else n)]
        del key, source, n, order, at
        key, doc = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        self.docs = []
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        at = runs(key, doc)
        key, doc = key[at], doc[at]
        own = runs(key)
        size = np.diff(np.append(own, len(key)))
        enough = np.unique(np.concatenate([*self.enough, key[own][size >= SUPPORT]]))
        few = np.repeat(size < SUPPORT, size) & ~np.isin(key, enough)
        self.docs, self.enough = [(key[few], doc[few])], [enough]
        self.held = len(self.entries[0][0]) + len(doc)

    def rows(self, names: pa.Array | None = None, last: bool = True) -> Iterator[pa.RecordBatch]:
        """Rows of SCHEMA in order of their keys; nothing is held afterwards but, without ``last``, what belongs to the item of the greatest number."""
        if not self.entries:
            return
        self.sum_up()
        (key, source, n), (doc_key, doc), enough = self.entries[0], self.docs[0], self.enough[0]
        names = pa.array(list(self.items), pa.binary()) if names is None else names
        langs, sources = pa.array(list(self.langs), pa.string()), pa.array(list(self.sources), pa.string())
        starts = runs(key)
        own = key[starts]
        first = np.searchsorted(doc_key, own)
        most = len(own) if last or not len(own) else int(np.searchsorted(own, (own[-1] >> LANG_BITS) << LANG_BITS))
        for lo in range(0, most, ROWS_OUT):
            hi = min(lo + ROWS_OUT, most)
            e0, e1 = starts[lo], starts[hi] if hi < len(starts) else len(key)
            d0, d1 = first[lo], first[hi] if hi < len(first) else len(doc)
            item = names.take(pa.array(own[lo:hi] >> LANG_BITS)).cast(pa.string())
            lang = langs.take(pa.array(own[lo:hi] & ((1 << LANG_BITS) - 1)))
            by, of = starts[lo:hi] - e0, first[lo:hi] - d0
            numbers = np.insert(doc[d0:d1], np.repeat(of, np.diff(np.append(by, e1 - e0))), n[e0:e1])
            yield pa.RecordBatch.from_arrays([lang, item, lists(sources.take(pa.array(source[e0:e1])), by), lists(pa.array(numbers), by + of)], schema=ROWS)
        rest = slice(starts[most], None) if most < len(starts) else slice(len(key), None)
        kept = slice(first[most], None) if most < len(first) else slice(len(doc), None)
        entries, docs, still = (key[rest], source[rest], n[rest]), (doc_key[kept], doc[kept]), enough[np.isin(enough, own[most:])]
        items = self.items
        self.items, self.entries, self.docs, self.enough, self.held = Codes(), [], [], [], 0
        if len(entries[0]):
            name, lang_of = next(x for x, i in items.items() if i == int(own[-1] >> LANG_BITS)), (1 << LANG_BITS) - 1
            self.items[name] = 0
            self.add(entries[0] & lang_of, entries[1], entries[2], docs[0] & lang_of, docs[1], still & lang_of)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of SCHEMA as flat values: row, source and number of each count, row and id of each document, and the rows with enough documents."""
    several, many = (pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in (2, 3))
    row = np.repeat(np.arange(len(many)), many)
    numbers = pc.list_flatten(batch.column(3)).to_numpy()
    counts = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) < np.repeat(several, many)
    return row[counts], pc.list_flatten(batch.column(2)), numbers[counts], row[~counts], numbers[~counts], np.flatnonzero(many == several)


def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang, source) to rows of SCHEMA, one for each chunk and language of the task (more where its memory is full). Chunks are told apart by 64-bit fingerprints within a task."""
    doc, held = TaskContext.get().partitionId() << 40, 0
    counts, parts = Counts(), []

    def rows() -> Iterator[pa.RecordBatch]:
        hashes, docs, ns, langs, sources, ids, own_hashes, own_names = (list(x) for x in zip(*parts, strict=True))
        parts.clear()  # what follows holds arrays of all parts
        base = np.cumsum([0, *[len(x) for x in ids[:-1]]])
        hashes, ns = np.concatenate(hashes), np.concatenate(ns)
        docs = np.concatenate([d + b for d, b in zip(docs, base, strict=True)])
        langs, sources, ids = np.concatenate(langs), np.concatenate(sources), np.concatenate(ids)
        known, at = np.unique(np.concatenate(own_hashes), return_index=True)
        item = np.searchsorted(known, hashes)
        # Items in the order of their first documents, so that rows that follow each other are alike and compress well.
        first = np.empty(len(known), np.int64)
        first[item[::-1]] = docs[::-1]
        order = np.argsort(first, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names = pa.concat_arrays(own_names).take(pa.array(at[order]))
        key = (rank[item] << LANG_BITS) | langs[docs]
        counts.add(key, sources[docs], ns, key, ids[docs], np.empty(0, np.int64))
        del hashes, docs, ns, ids, own_hashes, own_names, item, first, order, rank, key
        yield from counts.rows(names)

    for batch in batches:
        for part in slices(batch, most=2 << 20):
            words = Words(part.column("text"))
            order = np.argsort(words.hash, kind="stable")
            hashes, docs = words.hash[order], words.doc[order]
            at = runs(hashes, docs)
            first = order[runs(hashes)]
            spans = np.stack([words.start[first], words.end[first]], axis=1)
            size = np.append(0, np.cumsum(spans[:, 1] - spans[:, 0]))
            place = np.repeat(spans[:, 0] - size[:-1], np.diff(size)) + np.arange(size[-1])
            names = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(size.astype(np.int32).tobytes()), pa.py_buffer(words.data[place].tobytes())])
            ids = doc + np.arange(part.num_rows)
            parts.append((hashes[at], docs[at], np.diff(np.append(at, len(hashes))), counts.langs.of(part.column("lang")), counts.sources.of(part.column("source")), ids, words.hash[first], names))
            doc, held = doc + part.num_rows, held + len(at)
            if held > HELD:
                yield from rows()
                parts, held = [], 0
    if parts:
        yield from rows()


def chunks_to_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of item: every distinct chunk is tokenized once; its terms get its documents and its occurrences."""
    counts, last, last_terms = Counts(), None, Counter()
    for batch in batches:
        coded = batch.column(1).cast(pa.binary()).dictionary_encode()
        terms, times, sizes = [], [], []
        for chunk in coded.dictionary.to_pylist():
            if chunk != last:
                last, last_terms = chunk, Counter(TERM.findall(chunk.translate(LOWER)))
            sizes.append(len(last_terms))
            for term, n in last_terms.items():
                terms.append(counts.items.setdefault(term, len(counts.items)))
                times.append(n)
        terms, times, sizes = np.array(terms, np.int64), np.array(times, np.int64), np.array(sizes, np.int64)
        chunk_of, lang = coded.indices.to_numpy(), counts.langs.of(batch.column(0))
        start = np.cumsum(sizes) - sizes

        def spread(row: np.ndarray, start=start, sizes=sizes, chunk_of=chunk_of) -> tuple[np.ndarray, np.ndarray]:
            """For values of rows: each value once for each term of its row's chunk, and the places of these terms."""
            own = sizes[chunk_of[row]]
            value = np.repeat(np.arange(len(row)), own)
            inside = np.arange(len(value)) - np.repeat(np.cumsum(own) - own, own)
            return value, start[chunk_of[row]][value] + inside

        def keys(row: np.ndarray, value: np.ndarray, term: np.ndarray, terms=terms, lang=lang) -> np.ndarray:
            return (terms[term] << LANG_BITS) | lang[row[value]]

        row, sources, ns, doc_row, docs, full = flat(batch)
        value, term = spread(row)
        entries = keys(row, value, term), counts.sources.of(sources)[value], ns[value] * times[term]
        doc_value, doc_term = spread(doc_row)
        full_value, full_term = spread(full)
        counts.add(*entries, keys(doc_row, doc_value, doc_term), docs[doc_value], keys(full, full_value, full_term))
        if counts.held > HELD:
            counts.sum_up()
            if counts.held > HELD // 2:
                yield from counts.rows()
    yield from counts.rows()


def kept_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of item, to (lang, term, sources, ns) of the terms with enough documents."""
    counts = Counts()

    def enough(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            many = pc.equal(pc.list_value_length(batch.column(2)), pc.list_value_length(batch.column(3)))
            yield batch.filter(many).rename_columns(["lang", "term", "sources", "ns"])

    for batch in batches:
        key = (counts.items.of(batch.column(1).cast(pa.binary())) << LANG_BITS) | counts.langs.of(batch.column(0))
        row, sources, ns, doc_row, docs, full = flat(batch)
        counts.add(key[row], counts.sources.of(sources), ns, key[doc_row], docs, key[full])
        if counts.held > HELD // 4:
            yield from enough(counts.rows(last=False))  # what comes next may still be of the last item
    yield from enough(counts.rows())


def term_counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang, source; no nulls) to (lang, term, sources, ns): each kept term's occurrences by source."""
    chunks = docs.select("text", "lang", "source").mapInArrow(count_chunks, SCHEMA)
    terms = chunks.repartition("item").sortWithinPartitions("item", "lang").mapInArrow(chunks_to_terms, SCHEMA)
    return terms.repartition("lang", "item").sortWithinPartitions("item", "lang").mapInArrow(kept_terms, "lang string, term string, sources array<string>, ns array<long>")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total), in steps of 1,000 so that nothing overflows."""
    value, rest = np.divmod(n, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        value = value * 1000 + digits
    return value + 1


def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, sources, ns, groups, totals, v) to (lang, source, item, value): sums over the task's terms for each two sources of a language."""
    sums: dict[str, tuple[list[str], np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (groups, total) in sums.items():
            names, n = pa.array(groups, pa.string()), len(groups)
            for i in range(n):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * n, pa.string()), "source": pa.array([groups[i]] * n, pa.string()), "item": names, "value": total[i]})
        sums.clear()

    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            own = batch.filter(pc.equal(batch.column("lang"), lang))
            first = own.slice(0, 1).to_pylist()[0]
            groups, v = first["groups"], first["v"]
            place = {g: i for i, g in enumerate(groups)}
            totals = np.array(first["totals"], np.int64) + SMOOTH * v
            lists = own.column("sources")
            term = np.repeat(np.arange(own.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.array([place[s] for s in lists.flatten().to_pylist()], np.int64)
            p = np.tile(shares(np.full(len(groups), SMOOTH, np.int64), totals), (own.num_rows, 1))
            p[term, at] = shares(own.column("ns").flatten().to_numpy() + SMOOTH, totals[at])
            total = sums.setdefault(lang, (groups, np.zeros((len(groups), len(groups)), np.int64)))[1]
            for i in range(len(groups)):
                apart = p - p[:, i : i + 1]
                total[i] += (apart * apart // (p + p[:, i : i + 1])).sum(axis=0)
        if sum(t.size for _, t in sums.values()) > DISTANCES:
            yield from rows()
    yield from rows()


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * v)), in whole numbers of any size."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + SMOOTH), whole(total + SMOOTH * v)) + 1


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source)."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    terms = written(term_counts(docs), "terms")
    single = terms.select("lang", "term", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("ns").alias("n"))).alias("x"), F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"))
    single = single.select("lang", "term", F.col("x.source").alias("source"), F.col("x.n").alias("n"), "all")
    # One row a group, with its terms' sum and its language's.
    sums = single.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = written(groups, "groups")
    n_groups = groups.count()
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g"))
    langs = langs.join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    langs = written(langs.select("lang", "lang_total", "v", F.col("g.source").alias("groups"), F.col("g.total").alias("totals")), "langs")

    summed = terms.select("lang", "sources", "ns").join(if_small(langs.select("lang", "groups", "totals", "v"), n_groups), "lang").select("lang", "sources", "ns", "groups", "totals", "v")
    summed = summed.mapInArrow(distances, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    own = single.join(if_small(groups, n_groups), ["lang", "source"]).join(if_small(langs.select("lang", "lang_total", "v"), n_groups), "lang")
    own = own.withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", share(F.col("all"), F.col("lang_total"), F.col("v"))).where("n > 0 and p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))

    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", order).unionByName(own.withColumn("rank", order).where(F.col("rank") <= TOP))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with docs as (select row_number() over () as d, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
found as (
  select d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs),
kept as (select lang, term, count(*)::hugeint as n from found group by lang, term having count(distinct d) >= 10),
sizes as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
groups as (select distinct lang, source from docs),
own as (select f.lang, f.source, f.term, count(*)::hugeint as n from found f join kept using (lang, term) group by f.lang, f.source, f.term),
sums as (select lang, source, sum(n)::hugeint as total from own group by lang, source),
shares as (
  select g.lang, g.source, k.term, coalesce(o.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(o.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * z.v) as p,
    1 + (1000000000::hugeint * (k.n + 2)) // (z.total + 2 * z.v) as q
  from groups g join kept k on g.lang = k.lang join sizes z on g.lang = z.lang
  left join sums s on g.lang = s.lang and g.source = s.source left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(p.value, 0)::bigint as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source left join pairs p on p.lang = g.lang and p.source = g.source and p.item = h.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
