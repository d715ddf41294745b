"""Word and n-gram fingerprints of whole Arrow batches, computed with numpy inside Spark tasks.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``. UTF-8 never uses those bytes
inside a character, so words can be cut on the bytes. Fingerprints are 64-bit and do not depend on the
process, the batch or the partition.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: What a worker keeps for later tasks, by operator.
_kept: dict[str, dict] = {}


def keep_only(operator: str) -> dict:
    """What the operator keeps in this worker. What others have left goes, as workers outlive their stages."""
    for other in [k for k in _kept if k != operator]:
        del _kept[other]
    return _kept.setdefault(operator, {})


def give_back() -> None:
    """Return memory that is free, but still held by this process, to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task over batches that drops what operators of other modules keep in its worker, and gives its memory back when it has ended: idle workers stand beside the stages that follow, also those without Python."""
    operator = task.__module__.rsplit(".", 1)[-1]

    @functools.wraps(task)
    def run(*args, **kwargs) -> Iterator:
        if any(other != operator for other in _kept):
            keep_only(operator)
            give_back()
        try:
            yield from task(*args, **kwargs)
        finally:
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
GRAM = 0xA0761D6478BD642F
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"]


class Words:
    """Words of a list of texts. doc: index of the text; start, end: bytes in ``data``; hash: per word;
    first: index of each text's first word, and the number of words at the end."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        self.offsets = offsets = offsets - offsets[0]
        self.data = data = LOWER[data] if lower else data
        n = len(data)
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1] | edge[1:-1]
        closes[:-1] &= ~solid[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        up, down = _power(max(n, 1))
        value = BYTE[data] * up[:n]
        total = np.cumsum(value)
        self.hash = mix((total[self.end - 1] - total[self.start] + value[self.start]) * down[self.start]) if n else np.empty(0, U64)

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, k: int) -> np.ndarray:
        """Fingerprint of the k words from each word on; those across two texts, or past the end, are noise."""
        return mix(gram_sums(self.hash, k) + U64(k))

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one text."""
        ok = np.zeros(len(self), bool)
        if len(self) >= k:
            ok[: len(self) - k + 1] = self.doc[k - 1 :] == self.doc[: len(self) - k + 1]
        return ok


def gram_sums(h: np.ndarray, k: int) -> np.ndarray:
    """sum(h[i + j] * GRAM**j for j < k) for each i, by doubling; zeros stand past the end."""

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by < len(x):
            out[: len(x) - by] = x[by:]
        return out

    total, done, power = np.zeros_like(h), 0, h
    step = 1
    while True:
        if k & step:
            total = total + ahead(power, done) * U64(pow(GRAM, done, 1 << 64))
            done += step
        if done == k:
            return total
        power = power + ahead(power, step) * U64(pow(GRAM, step, 1 << 64))
        step *= 2


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of every text, one after the other, and where each text begins.

    With fewer than k words the whole sequence is one shingle; without words the set is empty."""
    n = np.diff(words.first)
    grams, ok = words.grams(k), words.whole(k)
    docs, values = words.doc[ok], grams[ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.empty(len(short), U64)
        for size in range(1, k):
            of = n[short] == size
            extra[of] = words.grams(size)[words.first[:-1][short[of]]]
        docs, values = np.concatenate([docs, short]), np.concatenate([values, extra])
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    docs, values = docs[fresh], values[fresh]
    return values, np.searchsorted(docs, np.arange(len(n) + 1))
