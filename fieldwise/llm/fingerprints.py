"""Operator 12: document fingerprints as threshold-scaled sketches of word shingles.

A document's sketch holds the hash of every distinct five-word shingle that falls below a fixed fraction (1 / ``SCALED``) of the hash range, and its
smallest hash if none does. Which shingles are kept depends on the shingle alone, so sketches of documents of any length can be compared and
merged: the sketch of several documents is the union of theirs, shared hashes over all hashes estimate their likeness (Jaccard), and shared hashes over
one document's hashes how much of it the other one contains, however long that is. Words are runs outside white space, in lower case; fewer than five are one shingle.

``compare_with_edits`` compares each document with an edited text of its own, whose last quarter is the beginning of the next document, and with that next one.
Neighbours are found on ids alone: these are dealt by ranges, ordered there, and each range's last document takes the next range's first. Texts move once, and of each text as much of its beginning as its neighbour needs.

Nulls: a null text is an empty one; its sketch is empty, is like another empty one (1) and like nothing else (0). A null doc_id comes first. Rows with one doc_id are ordered by a hash of their texts;
rows that also share the text are one document, returned for each row. A single document is its own next one. Extra columns are ignored. An empty table gives no rows.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwise.llm.store import dropped, shuffle_partitions, table, written

#: Words of a shingle; one of so many hashes is kept; bits of a hash.
SHINGLE, SCALED, BITS = 5, 4, 31
SPACE = "[\\x20\\x09-\\x0D]+"


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with value worked out once."""
    return F.transform(F.array(value), of)[0]


def _hash(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS).cast("int")


def shingles(text: Column) -> Column:
    """The hashes of the five-word shingles of a text, repeats included."""
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")

    def of(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - SHINGLE)
        some = F.transform(starts, lambda i: _hash(*[F.get(h, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, some).when(F.size(h) > 0, F.array(_hash(h))).otherwise(F.array().cast("array<int>"))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def sketch(text: Column, scaled: int = SCALED) -> Column:
    """The sorted hashes that a text keeps."""

    def of(h: Column) -> Column:
        low = bound(F.filter(h, lambda x: x < (1 << BITS) // scaled), lambda x: F.when(F.size(x) > 0, x).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(x))
        return F.sort_array(F.array_distinct(low))

    return bound(shingles(text), of)


def fingerprint(kept: Column) -> Column:
    """A sketch as text, eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(kept, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def from_fingerprint(text: Column) -> Column:
    """The sketch that ``fingerprint`` wrote."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(0), (F.length(text) / 8 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substr(text, i * 8 + 1, F.lit(8)), 16, 10).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of what two sketches stand for."""
    return bound(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) > 0, n / (F.size(a) + F.size(b) - n)).otherwise(F.lit(1.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first one's shingles that stand in the second; 1 for an empty one."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def merged(sketches: DataFrame, key: str, kept: str = "kept") -> DataFrame:
    """(key, hash): the union sketch of each key as rows, so that a key with a third of all documents is no single value.

    A document's smallest hash, kept only as it has none below the fraction, is left out: it says nothing about the union."""
    return sketches.select(key, F.explode(kept).alias("hash")).where(F.col("hash") < (1 << BITS) // SCALED).distinct()


def neighbours(ids: DataFrame) -> DataFrame:
    """ids (key) to (key, next_key): distinct keys in ascending order, the first after the last."""
    ranged = ids.distinct().repartitionByRange(shuffle_partitions(ids.sparkSession), "key").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    # One row for each range.
    after = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(Window.orderBy("part"))).alias("after"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return ranged.withColumn("inside", inside).join(F.broadcast(after), "part").select("key", F.coalesce("inside", "after").alias("next_key"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_next, n_kept)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("doc_id", F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))
    sketches = written(rows.select("key", F.length("text").cast("long").alias("n_chars"), sketch(F.col("text")).alias("kept")), "sketches")
    chain = written(neighbours(sketches.select("key")), "chain")
    unique = sketches.dropDuplicates(["key"])
    known = chain.join(unique, "key").join(unique.select(F.col("key").alias("next_key"), F.col("kept").alias("next_kept")), "next_key")
    known = written(known.withColumns({"near_next": likeness(F.col("kept"), F.col("next_kept")), "in_next": containment(F.col("kept"), F.col("next_kept"))}).drop("next_kept"), "neighbours")
    for table_ in (sketches, chain):
        dropped(docs.sparkSession, table_)
    wanted = known.select(F.col("next_key").alias("key"), F.col("key").alias("of"), F.floor(F.col("n_chars") / 4).cast("int").alias("most"))
    heads = rows.join(wanted, "key").select(F.col("of").alias("key"), F.substring("text", F.lit(1), F.col("most")).alias("head")).dropDuplicates(["key"])
    both = rows.join(known, "key").join(heads, "key")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), F.col("head"))
    out = both.select("key", "n_chars", "kept", "near_next", "in_next", edited.alias("edited")).withColumn("edited_kept", sketch(F.col("edited")))
    return out.select(
        "key.doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("kept")).alias("fingerprint"), fingerprint(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"), "near_next", "in_next", F.size("kept").alias("n_kept"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
