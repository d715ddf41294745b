"""Many fixed strings looked for in many texts in one pass: an Aho-Corasick automaton of the strings, walked once over each text.

The strings are cut into blocks of a bounded number of characters. A block is sent to the tasks, which build its automaton once for each worker; texts stay where they are, and no text is
compared with a string that doesn't stand in it. Where strings fill several blocks, each block's hits are kept before the next is sent, so one block at a time is in memory."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.sources.scratch import cut

#: Characters of the strings of a block; its automaton takes some tens of bytes for each.
BLOCK = 2_000_000
_automata: dict = {}


def automaton(strings: list[str], key: object = None):
    """The automaton of distinct strings without empty ones; of the last key, it is remembered."""
    import ahocorasick

    if key is None or key not in _automata:
        found = ahocorasick.Automaton()
        for i, s in enumerate(strings):
            found.add_word(s, (i, len(s)))
        found.make_automaton()
        _automata.clear()
        _automata[key] = found
    return _automata[key]


def times_in(text: str, found) -> dict[int, int]:
    """How often each string stands in a text, from left to right and without overlaps of its own."""
    times: dict[int, int] = {}
    ends: dict[int, int] = {}
    for end, (i, n) in found.iter(text):
        if end - n >= ends.get(i, -1):
            ends[i] = end
            times[i] = times.get(i, 0) + 1
    return times


def found_patterns(texts: DataFrame, patterns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(text_id, pattern, n_times) of texts (text_id, text) and patterns (pattern): every distinct pattern that stands in a text. Null and empty texts and patterns find nothing."""
    spark, kind = texts.sparkSession, texts.schema["text_id"].dataType.simpleString()
    strings = patterns.select("pattern").where("pattern <> ''").distinct()
    n_chars = strings.agg(F.sum(F.length("pattern"))).first()[0] or 0
    n_blocks = max(1, -(-n_chars // block))
    parts = []
    for b in range(n_blocks):
        own = strings if n_blocks == 1 else strings.where(F.pmod(F.xxhash64("pattern"), F.lit(n_blocks)) == b)
        shared = spark.sparkContext.broadcast([r["pattern"] for r in own.collect()])

        def walk(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            known = shared.value
            if not known:
                return
            machine, names = automaton(known, key), pa.array(known, pa.string())
            for batch in batches:
                rows, which, times = [], [], []
                for row, text in enumerate(batch.column(1)):
                    if text.is_valid:
                        for i, n in times_in(text.as_py(), machine).items():
                            rows.append(row)
                            which.append(i)
                            times.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), names.take(pa.array(which, pa.int64())), pa.array(times, pa.int64())], names=["text_id", "pattern", "n_times"])

        part = texts.select("text_id", "text").mapInArrow(walk, f"text_id {kind}, pattern string, n_times long")
        if n_blocks > 1:
            part = cut(part)
            shared.destroy()
        parts.append(part)
    return reduce(DataFrame.union, parts)
