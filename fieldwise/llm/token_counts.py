"""Operator 9: token counts by a unigram model, with one dynamic program over a trie of pre-tokens.

Pre-tokens are the runs between white space, opened by the word mark. The distinct new ones of a run of documents are put in order, which is the depth-first walk of their trie:
the best forward score and its number of pieces are computed once for each shared prefix and kept on the path; a
pre-token's own count stands at its end and is remembered. A document's count is the sum over its pre-tokens.

The vocabulary is a public one, not trained here; it has no probabilities, so a piece's log probability follows its rank by Zipf's law (or is given). Characters outside
the vocabulary cost one piece for each byte. Of equal scores the one with fewer pieces counts.

Nulls: a null or empty text has no tokens. Repeated rows are counted each; extra columns are ignored; doc_id may be null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldwise.llm.store import table
from fieldwise.llm.text import slices

MARK = "▁"
#: Pre-tokens whose counts a worker remembers (the older half is forgotten when the memory is full), and bytes of text whose pre-tokens are put in one trie.
REMEMBERED, TOGETHER = 1_000_000, 8 << 20


class Unigram:
    """Pieces in a trie by their last character, so that all pieces that end at a place are found by walking back."""

    def __init__(self, pieces: list[str]):
        total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
        self.ends: dict = {}
        for i, piece in enumerate(pieces):
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node.setdefault("", -math.log(i + 1) - total)
        self.byte = -math.log(len(pieces) + 1) - total - 10
        self.known: dict[bytes, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        """Pieces of each word; words in sorted order share the work on common prefixes."""
        out, path, before = [], [(0.0, 0)], ""
        for word in words:
            text = MARK + word
            same, most = 0, min(len(text), len(before))
            while same < most and text[same] == before[same]:
                same += 1
            del path[same + 1 :]
            for j in range(same, len(text)):
                size = len(text[j].encode())
                score, n = path[j]
                best, fewest = score + size * self.byte, n + size
                node, i = self.ends, j
                while i >= 0 and (node := node.get(text[i])) is not None:
                    if (own := node.get("")) is not None:
                        score, n = path[i]
                        if (score + own, -n - 1) > (best, -fewest):
                            best, fewest = score + own, n + 1
                    i -= 1
                path.append((best, fewest))
            out.append(path[-1][1])
            before = text
        return out

    def count(self, texts: list[list[bytes]]) -> list[int]:
        """Pieces of each text, given as its pre-tokens; the new ones of all texts share one trie."""
        known, used = self.known, set().union(*texts)
        fresh = used.difference(known)
        if len(known) + len(fresh) > REMEMBERED:
            for w in list(known)[: len(known) // 2]:
                del known[w]
            fresh = used.difference(known)
        ordered = sorted(fresh)
        known.update(zip(ordered, self.counts([w.decode() for w in ordered]), strict=True))
        return [sum([known[w] for w in words]) for words in texts]


_models: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    """The pieces of a sentencepiece file in the order of their ids, without control, unknown and byte pieces."""
    if path not in _models:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        _models[path] = Unigram([p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))])
    return _models[path]


def token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = model(model_path)
        for batch in batches:
            for part in slices(batch, most=TOGETHER):
                words = [(t or b"").split() for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array([len(w) for w in words], pa.int64()), "n_tokens": pa.array(unigram.count(words), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
