"""Words, lines and rolling hashes of Arrow string batches, in numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Those bytes never
occur inside a multi-byte UTF-8 character, so words are found on bytes.
Batches are worked through in chunks of about ``CHUNK`` bytes (one document at
least), which bounds a worker's memory by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False  # continuation bytes are no code points of their own

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _rng.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _rng.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEN = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def row_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    chunk = (np.cumsum(size) - 1) // limit
    cuts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


class Words:
    """The words of one chunk: byte spans, the document of each, and its hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        bufs = texts.buffers()
        off = np.frombuffer(bufs[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and len(off) else np.empty(0, np.uint8)
        self.off = off - off[0]
        self.data = _LOWER[raw] if lower else raw
        self.n_docs = len(texts)
        word = ~_SPACE[self.data]
        edge = np.zeros(len(word) + 1, bool)
        edge[self.off] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, self.off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        #: Words from each word to the end of its document.
        self.left = self.first[self.doc + 1] - np.arange(len(self.starts))

    def hashes(self, kind: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, kind)

    def code_points(self) -> np.ndarray:
        """Characters in each word."""
        lead = np.concatenate(([0], np.cumsum(_LEAD[self.data])))
        return lead[self.ends] - lead[self.starts]

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each word over each document."""
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def grams(self, hashes: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
        """The hash of the n words from each word on; only those with ``left >= n`` are meant."""
        return gram_hashes(hashes, n, kind)

    def repeated(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Which words lie in an n-word window found twice or more in their own document."""
        at = np.flatnonzero(self.left >= n)
        key = mix(grams[at] + self.doc[at].astype(np.uint64) * _LEN)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(len(at), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        return self.covered(at[hit], n)

    def covered(self, windows: np.ndarray, n: int) -> np.ndarray:
        """Which words lie in one of the n-word windows that start at the given words."""
        step = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(step, windows, 1)
        np.add.at(step, windows + n, -1)
        return np.cumsum(step[:-1]) > 0


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hashes of disjoint byte spans in order, independent of where they stand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    power = np.full(int(length.max()), _BASE[kind], np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate(([0], np.cumsum(length)))
    inside = np.arange(total[-1]) - np.repeat(total[:-1], length)
    value = _BYTE[kind][data[np.repeat(starts, length) + inside]] * power[inside]
    run = np.zeros(total[-1] + 1, np.uint64)
    np.cumsum(value, out=run[1:])
    return mix(run[total[1:]] - run[total[:-1]] + length.astype(np.uint64) * _LEN)


def gram_hashes(hashes: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """Polynomial hashes of n consecutive values, by doubling; padded at the end to the same length."""
    base = int(_GRAM[kind])
    out, have, power = np.zeros(len(hashes), np.uint64), 0, 1
    block, size = hashes, 1
    while size <= n:
        if n & size:  # out covers the first `have` values; append this block
            shifted = np.zeros_like(out)
            shifted[: max(0, len(out) - have)] = block[have:]
            out = out * np.uint64(pow(base, size, 2**64)) + shifted
            have += size
        nxt = np.zeros_like(block)
        nxt[: max(0, len(block) - size)] = block[size:]
        block = block * np.uint64(pow(base, size, 2**64)) + nxt
        size *= 2
    return mix(out)


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the \\n-split lines that hold a word, and the document of each."""
    data, off = words.data, words.off
    cut = np.flatnonzero(data == 0x0A)
    starts = np.concatenate((off[:-1], cut + 1))
    ends = np.concatenate((off[1:], cut))
    starts.sort()
    ends.sort()
    word = np.concatenate(([0], np.cumsum(~_SPACE[data])))
    has = word[ends] > word[starts]
    starts, ends = starts[has], ends[has]
    return starts, ends, np.searchsorted(off, starts, side="right") - 1
