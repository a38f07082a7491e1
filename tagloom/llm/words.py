"""Vectorised words: positions and 64-bit hashes of all words of an Arrow batch of texts.

Words are found on the UTF-8 bytes, so any definition by ASCII separators is exact.  A word's hash is a
polynomial of its bytes modulo 2**64, mixed; sequences of words are hashed by the same polynomial over
the words' hashes (Rabin-Karp), so every window of a text costs a few array operations.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE_BYTES = [9, 10, 11, 12, 13, 32]


def byte_class(member) -> np.ndarray:
    """A table over bytes: does the byte belong to words?"""
    return np.array([bool(member(b)) for b in range(256)])


NOT_SPACE = byte_class(lambda b: b not in SPACE_BYTES)
LETTERS_DIGITS = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.full(size, b, np.uint64) for b in (self.base, self.inverse))
            for power in (self.up, self.down):
                power[0] = 1
                np.cumprod(power, out=power)
        return self.up[:n], self.down[:n]


_bytes, _words = Powers(_BASE), Powers(_WORD_BASE)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of consecutive texts: ``start``/``end`` byte positions in ``data``, ``hash``, the text
    (``doc``) of each, and ``first``: the number of the first word of every text, with one more at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = is_word[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty(n, bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):  # pieces bound the memory, also within one very long text
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.start, low + CHUNK_BYTES)))
            part = data[low:self.end[to - 1]]
            up, down = _bytes.of(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(((part if fold is None else fold[part]).astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            s, e = self.start[at:to] - low, self.end[at:to] - low
            self.hash[at:to] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            at = to

    def windows(self, size: int) -> np.ndarray:
        """Rabin-Karp hash of the ``size`` words from each word on (of ``len(words) - size + 1``
        starts; those that run over a text's end mean nothing)."""
        return window_hashes(self.hash, size)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _words.of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mixed((total[size:] - total[:-size]) * down[:n - size + 1])


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words ``start:end`` of each span."""
    n = len(hashes)
    up, down = _words.of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array, without a copy; a null text is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text_col: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``most`` bytes of text (one text at least), with bytes and offsets."""
    data, offsets = buffers(batch.column(text_col))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_chunks(batches: Iterator[pa.RecordBatch], text_col: str, is_word: np.ndarray,
                fold: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, Words]]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for part, data, offsets in chunks(batch, text_col):
                yield part, Words(data, offsets, is_word, fold)
