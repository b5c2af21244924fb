"""Word splitting and hashing over Arrow string batches, in numpy.

A batch of texts is read as one byte buffer. Separators are single ASCII bytes, so UTF-8
needs no decoding: every byte of a multi-byte character belongs to a word. Words get a 64-bit
hash from one running polynomial over the buffer, and n-grams a hash of their word hashes.
Memory per call follows the bytes given; ``pieces`` cuts a batch so that it stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
BLOCK = 1 << 19

_rng = np.random.default_rng(20240611)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, BLOCK + 1), _powers(_BASE_INV, BLOCK + 1)


@dataclass
class Words:
    """Words of several texts in order: byte range in ``data``, text number and hash of each; and of
    each text its number of words, its first word and its first byte."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    begin: np.ndarray

    def grams(self, n: int, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of ``n`` words of one text."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = self.hash[:size] * _GRAM[0]
        for j in range(1, n):
            total += self.hash[j : j + size] * _GRAM[j]
        at = np.flatnonzero(self.text[:size] == self.text[n - 1 :])
        return at, mix(total[at] + np.uint64(n))

    def whole(self, texts: np.ndarray) -> np.ndarray:
        """One hash for the whole word sequence of each given text (of at most 64 words)."""
        out = np.zeros(len(texts), np.uint64)
        for i, t in enumerate(texts):
            a, n = self.first[t], self.counts[t]
            out[i] = (self.hash[a : a + n] * _GRAM[:n]).sum(dtype=np.uint64) + np.uint64(n)
        return mix(out)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or a single row."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    upto, a = np.cumsum(sizes), 0
    while a < n:
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, side="right"))
        b = max(b, a + 1)
        yield batch.slice(a, b - a)
        a = b


def split(texts: pa.Array, table: np.ndarray, fold: bool) -> Words:
    """Words of each text: maximal runs of bytes that ``table`` accepts; null has none.

    ``fold`` hashes A-Z as a-z.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = table[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    bound = np.searchsorted(start, offsets)
    first, counts = bound[:-1], np.diff(bound)
    text = np.repeat(np.arange(n), counts)
    return Words(data, start, end, text, _hash(data, start, end, _FOLDED if fold else _BYTES), counts, first, offsets[:-1])


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Polynomial hash of each byte range from prefix sums, taken block by block."""
    head, tail, scale = (np.empty(len(start), np.uint64) for _ in range(3))
    carry, power, inverse = np.uint64(0), np.uint64(1), np.uint64(1)
    with np.errstate(over="ignore"):
        for a in range(0, len(data), BLOCK):
            block = data[a : a + BLOCK]
            sums = np.empty(len(block) + 1, np.uint64)
            sums[0] = carry
            np.multiply(values[block], _POW[: len(block)] * power, out=sums[1:])
            np.add.accumulate(sums, out=sums)
            b = a + len(block)
            i, j = np.searchsorted(start, [a, b])
            head[i:j], scale[i:j] = sums[start[i:j] - a], _INV[start[i:j] - a] * inverse
            i, j = np.searchsorted(end, [a + 1, b + 1])
            tail[i:j] = sums[end[i:j] - a]
            carry, power, inverse = sums[-1], power * _POW[BLOCK], inverse * _INV[BLOCK]
        return mix((tail - head) * scale + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
