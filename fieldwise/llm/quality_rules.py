"""Operator 5: line-first cleaning, then document rules.

Each line with a word is judged on its own: punctuation (symbols, or exclamation marks, out of proportion),
navigation (separators as in menus and tables), boilerplate (site phrases in the languages of the corpus) and repetition (a line that says
few words over and over). Failing lines are removed; a document that loses too much of its words, or keeps too few, is
rejected. The base counts are taken on the whole input text.

Nulls: a null text has no words and fails. Empty texts fail. Other columns are carried through unchanged by
``clean``; ``judge`` returns one row for each row, repeated rows included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.llm.store import small_batches, table
from fieldwise.llm.text import Words, slices, tidy

MIN_WORDS = 20
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BOILERPLATE = (
    "cookie policy|privacy policy|terms of (use|service)|all rights reserved|sign in to|log in to|subscribe to|click here|javascript is"
    "|cookie-richtlinie|datenschutzerklärung|alle rechte vorbehalten|newsletter abonnieren|politique de confidentialité|mentions légales|tous droits réservés|cliquez ici"
    "|política de privacidad|aviso legal|todos los derechos reservados|haga clic aquí"
)
SEPARATORS = "|»›·"
_separators = [c.encode() for c in SEPARATORS]
_boilerplate = re.compile(BOILERPLATE)
_symbols = bytes(np.flatnonzero(SYMBOL).tolist())
ASCII_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_lower = bytes.maketrans(*ASCII_LOWER)


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line that has the given words is no prose."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, _symbols))
    if symbols * 10 > 3 * n or line.count(b"!!") * 2 > n or sum(line.count(c) for c in _separators) >= 3:
        return True
    if n >= 9 and 3 * len(set(words)) <= n:
        return True
    return bool(_boilerplate.search(line.translate(_lower).decode()))


def judge_lines(text: str | None) -> tuple[int, int, str]:
    """Copies of earlier lines; words in failing lines; the text without those lines."""
    copies, lost, kept, seen = 0, 0, [], set()
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        if not words:
            kept.append(line)
            continue
        if line in seen:
            copies += 1
        else:
            seen.add(line)
        if line_fails(line, words):
            lost += len(words)
        else:
            kept.append(line)
    return copies, lost, b"\n".join(kept).decode() if lost else text or ""


def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def repeated_words(words: Words, k: int = 8) -> np.ndarray:
    """For each text, the words inside windows of k words that the text has twice or more."""
    ok = np.flatnonzero(words.whole(k))
    key = words.grams(k)[ok] ^ (words.doc[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = ok[pd.Series(key).duplicated(keep=False).to_numpy()]
    step = np.zeros(len(words) + 1, np.int64)
    step[again] += 1
    np.subtract.at(step, again + k, 1)
    return per_text(np.cumsum(step[:-1]) > 0, words.first)


@tidy
def judged(batches: Iterator[pa.RecordBatch], with_text: bool, max_lost: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            n = np.diff(words.first)
            points = ~np.isin(words.data, [0x20, *range(9, 14)]) & ((words.data & 0xC0) != 0x80)
            repeat = repeated_words(words)
            lines = [judge_lines(t) for t in part.column("text").to_pylist()]
            lost = np.array([x[1] for x in lines], np.int64)
            base = (n < MIN_WORDS) | (100 * repeat > 30 * n)
            kept = ~base & (100 * lost <= max_lost * n) & (n - lost >= MIN_WORDS)
            found = {
                "n_words": n.astype(np.int64), "word_chars": per_text(points, words.offsets), "n_symbols": per_text(SYMBOL[words.data], words.offsets),
                "n_dup_lines": np.array([x[0] for x in lines], np.int64), "n_repeat_words": repeat, "base_failed": base, "kept": kept, "n_lost_words": lost,
            }
            if not with_text:
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | {k: pa.array(v) for k, v in found.items()})
                continue
            keep = pa.array(kept)
            columns = {c: part.column(c) for c in part.schema.names} | {"text": pa.array([x[2] for x in lines], pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pc.utf8_length(columns["text"]).cast(pa.int64())
            yield pa.RecordBatch.from_pydict(columns).filter(keep)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long"


def judge(docs: DataFrame, max_lost: int = 30) -> DataFrame:
    """Counts and verdict for every document. max_lost: percent of the words that failing lines may take."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: judged(it, False, max_lost), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def clean(docs: DataFrame, max_lost: int = 30) -> DataFrame:
    """The accepted documents, with all their columns, without their failing lines; ``n_chars`` follows the text."""
    small_batches(docs.sparkSession)
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    return docs.mapInArrow(lambda it: judged(it, True, max_lost), docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


#: The same in SQL, on whole texts: lines and windows are unnested.
OP5_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, string_split(text, chr(10)) as ls from d),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from w),
lw as (select doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from l),
lj as (select doc_id, i, line, len(ws) as n, row_number() over (partition by doc_id, line order by i) as nth,
  (length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) * 10 > 3 * len(ws)
   or len(regexp_extract_all(line, '!!')) * 2 > len(ws)
   or length(regexp_replace(line, '[^{separators}]', '', 'g')) >= 3
   or (len(ws) >= 9 and 3 * len(list_distinct(ws)) <= len(ws))
   or regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{boilerplate}')) as fails
  from lw where len(ws) > 0),
la as (select doc_id, sum(case when nth > 1 then 1 else 0 end) as n_dup_lines, sum(case when fails then n else 0 end) as n_lost from lj group by doc_id),
p as (select doc_id, ws, unnest(range(1, len(ws) - 6)) as s from w where len(ws) >= 8),
g as (select doc_id, s, array_to_string(ws[s:s+7], ' ') as g from p),
r as (select doc_id, s from (select doc_id, s, count(*) over (partition by doc_id, g) as c from g) x where c > 1),
rw as (select doc_id, count(distinct s + k) as n_repeat_words from r cross join (select unnest(range(8)) as k) x group by doc_id),
f as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lost, 0) as n_lost_words
  from w left join la on w.doc_id = la.doc_id left join rw on w.doc_id = rw.doc_id),
b as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from f)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
 cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
 (not base_failed and 100 * n_lost_words <= 30 * n_words and n_words - n_lost_words >= 20) as kept, cast(n_lost_words as bigint) as n_lost_words
from b
""".replace("{boilerplate}", BOILERPLATE).replace("{separators}", SEPARATORS)
