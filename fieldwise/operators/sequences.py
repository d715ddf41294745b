"""What changed in the order of words: longest common subsequences, as runs of deleted and inserted words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that the rows of one comparison may take; a longer one is halved first.
BITS = 1 << 30
RUNS = "array<struct<op:string,at:int,words:array<string>>>"


def _rows(a: list[str], b: list[str]) -> list[int]:
    """For each beginning of b a number whose bits, one for each word of a, are 0 where the longest common subsequence with a's beginning grows by that word."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row, rows = full, []
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of b with each beginning of a, the empty one included."""
    row = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = row
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(a) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence."""
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    pairs: list[tuple[int, int]] = []
    if x and y:
        if len(x) * len(y) > BITS and len(y) > 1:
            # Halve b where the two sides' lengths sum up to the most.
            half = len(y) // 2
            cut = int(np.argmax(_lengths(x, y[:half]) + _lengths(x[::-1], y[half:][::-1])[::-1]))
            pairs = common(x[:cut], y[:half]) + [(i + cut, j + half) for i, j in common(x[cut:], y[half:])]
        else:
            rows, i, j = _rows(x, y), len(x), len(y)
            while i and j:
                if rows[j - 1] >> (i - 1) & 1:
                    i -= 1  # this word adds nothing to what stands before it
                elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
                    j -= 1  # it added as much without b's word
                else:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
            pairs.reverse()
    ends = [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]
    return [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in pairs] + ends


def runs(old: list[str], new: list[str]) -> list[dict]:
    """Runs in order: DELETE of words at a place of the old text, INSERT of words before it; deletions come first."""
    out, i, j = [], 0, 0
    for x, y in [*common(old, new), (len(old), len(new))]:
        if x > i:
            out.append({"op": "DELETE", "at": i, "words": old[i:x]})
        if y > j:
            out.append({"op": "INSERT", "at": x, "words": new[j:y]})
        i, j = x + 1, y + 1
    return out


def word_runs(old: Column, new: Column) -> Column:
    """Runs that turn the words of one text into those of another; words are parted by white space."""

    @F.pandas_udf(RUNS)
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([runs((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)])

    return of(old, new)


def applied(old: Column, changes: Column) -> Column:
    """The words of the old text after the runs, parted by single spaces."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, lists, strict=True):
            words, done, at = (text or "").split(), [], 0
            for r in own if own is not None else []:
                done += words[at : r["at"]]
                at = r["at"]
                if r["op"] == "DELETE":
                    at += len(r["words"])
                else:
                    done += list(r["words"])
            out.append(" ".join(done + words[at:]))
        return pd.Series(out)

    return of(old, changes)


def clause_runs(pairs: DataFrame) -> DataFrame:
    """pairs (clause_key, old, new) with ``runs``, and the numbers of words deleted and inserted, repeats and moves included."""
    count = lambda op: F.aggregate(F.filter("runs", lambda r: r["op"] == op), F.lit(0).cast("long"), lambda n, r: n + F.size(r["words"]))
    return pairs.withColumn("runs", word_runs(F.col("old"), F.col("new"))).withColumn("n_deleted", count("DELETE")).withColumn("n_inserted", count("INSERT"))
