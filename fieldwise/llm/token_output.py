"""Operator 3: token ids in ORC files, in ascending doc_id order, with row indexes and Bloom filters.

Documents are dealt by ranges of doc_id, sorted inside each range and encoded there, so that a range becomes
a shard whose documents are in order; shards are numbered in the order of their ranges. ORC encodes the ids by
integer run-length encoding, keeps min/max row indexes on every column and Bloom filters on ``doc_id``, so a
look-up reads only stripes that can hold the document, and stripes can be read in parallel.

Nulls: a null text is an empty one (the end id alone). A null doc_id sorts first. Documents with one doc_id, or none, stand in the order of
a hash of their texts and may fill several shards. Repeated rows are written once for each row. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwise.llm.store import shuffle_partitions, small_batches, table, work_dir
from fieldwise.llm.text import give_back, keep_only, slices, tidy

#: Words and parts of words whose ids a worker remembers; the older half is forgotten when they are more.
REMEMBERED = 600_000
#: Bytes of texts that are encoded together, and rows between the files' index entries.
BYTES, STRIDE = 2 << 20, 1000
SCHEMA = "shard int, doc_id long, start_in_shard long, n_tokens long, ids array<int>"


#: A pre-tokenizer that takes a run of letters, and one of other signs, as a pre-token each; signs that may end a word beside the letters.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIGNS = b".,;:!?$#*%&|<>()-"
_plain = re.compile(rb"([A-Za-z\x80-\xc6]+)([" + re.escape(SIGNS) + rb"]*)")
#: The character that byte-level vocabularies write for each byte: itself if it is printable, else the next one from 256 on.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_shown = dict(zip(_printable, map(chr, _printable), strict=True)) | {x: chr(256 + i) for i, x in enumerate(sorted(set(range(256)) - set(_printable)))}
SHOWN = [_shown[x] for x in range(256)]


class Encoder:
    """Ids of whole texts. White space always parts tokens, so each run between white space is encoded once and remembered.

    Where the tokenizer lower-cases and takes letters and signs apart, new words of Latin letters and signs are cut here and only their parts go to the tokenizer's
    model; words share most of them. All other words go through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.cuts_letters = steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": LETTER_RUNS} and cuts[1]["type"] == "ByteLevel"
        self.cuts_letters &= not any(cuts[1][x] for x in ("add_prefix_space", "use_regex")) if self.cuts_letters else False
        self.known: dict[bytes, bytes] = {}  # also parts of words, as a part has the ids that it has as a word

    def part(self, run: bytes) -> bytes:
        """Ids of one pre-token that is new, letters in lower case or signs."""
        found = self.model.tokenize(run.decode() if run.isascii() else "".join([SHOWN[x] for x in run]))
        ids = self.known[run] = packed([t.id for t in found])
        return ids

    def learn(self, fresh: list[bytes]) -> None:
        known, rest = self.known, fresh
        if self.cuts_letters:
            rest = []
            for w in fresh:
                if w.isalpha():  # of bytes: ASCII letters only
                    letters, signs = w if w.islower() else w.lower(), b""
                elif (m := _plain.fullmatch(w)) is None:
                    rest.append(w)
                    continue
                else:
                    letters, signs = m.groups()
                    if letters.isascii():
                        letters = letters.lower()
                    elif (text := letters.decode().lower()).isalpha():
                        letters = text.encode()
                    else:
                        rest.append(w)
                        continue
                ids = known.get(letters) or self.part(letters)
                known[w] = ids + (known.get(signs) or self.part(signs)) if signs else ids
        found = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        known.update(zip(rest, (packed(x.ids) for x in found), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all of them, each text's with ``end_id`` behind.

        Each different word of the texts is looked up once, and those that are new in all of them are learnt together."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # an empty word stands beside white space at either end; it has no ids
        words = lists.flatten().cast(pa.binary()).dictionary_encode()
        known, used = self.known, words.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [w for w in used if w not in known]
        if forget(known, len(fresh), REMEMBERED):
            fresh = [w for w in used if w not in known]
        if fresh:
            self.learn(fresh)
        own = list(map(known.__getitem__, used))
        flat, size = np.frombuffer(b"".join(own), "<i4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        word = words.indices.to_numpy()
        n = size[word]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(size) - size)[word] - upto[:-1], n) + np.arange(upto[-1])]
        edges = upto[lists.offsets.to_numpy()]
        return np.diff(edges) + 1, np.insert(ids, edges[1:], end_id)


_packers = [Struct(f"<{n}i").pack for n in range(16)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    return _packers[len(ids)](*ids) if len(ids) < len(_packers) else np.asarray(ids, "<i4").tobytes()


def forget(memory: dict, more: int, most: int) -> bool:
    """Drop the older half if ``more`` entries would be too many."""
    if len(memory) + more <= most:
        return False
    for key in list(memory)[: len(memory) // 2]:
        del memory[key]
    return True


def encoder(path: str) -> Encoder:
    own = keep_only("token_output")
    if path not in own:
        own[path] = Encoder(path)
    return own[path]


@tidy
def encode_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Sorted (doc_id, text) rows of one shard to rows of SCHEMA."""
    enc, start = encoder(path), 0
    shard = TaskContext.get().partitionId()
    for batch in batches:
        for part in slices(batch, most=BYTES):
            n, ids = enc.encode(part.column("text"), end_id)
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard, np.int32)), part.column("doc_id"), pa.array(start + ends - n), pa.array(n), lists],
                names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids"],
            )
            start += int(n.sum())
        give_back()  # columns of words take several times the batch


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ORC files under ``path``."""
    small_batches(docs.sparkSession)
    n = shuffle_partitions(docs.sparkSession)
    order = F.col("doc_id").asc_nulls_first(), F.col("tie")
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    encoded = ranged.select("doc_id", "text").mapInArrow(lambda it: encode_rows(it, tokenizer_path, end_id), SCHEMA)
    (
        encoded.write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(STRIDE))
        .option("orc.stripe.size", str(64 << 20))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (shard, doc_id, start, n_tokens, ids) of files written by write_tokens.

    start counts the ids of all documents before: the shards' sums (one row a written file) give where each shard starts."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    # One row for each written file: 12 bytes a task of the writing job.
    return rows.join(F.broadcast(starts), "shard").select("shard", "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")


@tidy
def id_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8)
        at = lists.offsets.to_numpy().astype(np.int64) * 4
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(id_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files in a working folder and return the digest of what the files hold."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return token_digest(read_tokens(docs.sparkSession, path))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))
