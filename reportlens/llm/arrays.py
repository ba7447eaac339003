"""Word arrays of Arrow text batches: hashes and places of words, computed without Python strings.

A word is `[^\\x20\\x09-\\x0D]+`. Hashes are 64 bit: a polynomial over the bytes of the word, then mixed;
two different words of a corpus of 10^9 words share one with a chance of about 3 in 100.
Null texts count as empty. Nothing here depends on the process, so any task gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and all bytes of longer characters stay; ASCII punctuation counts as white space.
PLAIN = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER.tolist()], np.uint8)
_BASE = 0x9E3779B97F4A7C15
#: Bytes handled at once; a longer document is one piece of its own.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=U) * U(_BASE) + U(seed * 1_000_003)) | U(1)


_CODE = constants(7, 256)
_powers = [np.ones(1, U), np.ones(1, U)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                _powers[k] = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, base, U))])
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of some documents: `first[d]:first[d + 1]` are those of document d."""

    hash: np.ndarray
    start: np.ndarray  # in bytes of `data`
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray  # bytes after folding
    text_at: np.ndarray  # where each document's bytes begin in `data`; one more at the end
    total: np.ndarray  # running polynomial over the bytes

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, equal for equal bytes."""
        return mix((self.total[end] - self.total[start]) * _powers_to(len(self.data) + 1)[1][start] + (end - start).astype(U))

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, at: np.ndarray, fold: np.ndarray | None = LOWER) -> Words:
    """data: bytes; at: ascending places where documents begin, and the end."""
    data = data[at[0]: at[-1]]
    at = at - at[0]
    if fold is not None:
        data = fold[data]
    n = len(data)
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[:-1][at[:-1] < at[1:]]  # of documents that have bytes
    begins[edge] = inside[edge]
    last = at[1:][at[:-1] < at[1:]] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, back = _powers_to(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_CODE[data] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * back[start] + (end - start).astype(U))
    return Words(h, start, end, np.searchsorted(start, at), data, at, total)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and places of an Arrow text column, without a copy where there is none to make."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1] if at else np.zeros(1)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at.astype(np.int64)


def pieces(column: pa.Array, fold: np.ndarray | None = LOWER) -> Iterator[tuple[int, int, Words]]:
    """Runs of documents of about PIECE bytes, as (first row, row after the last, words)."""
    data, at = texts(column)
    k, rows = 0, len(column)
    while k < rows:
        stop = max(k + 1, int(np.searchsorted(at, at[k] + PIECE, side="right")) - 1)
        yield k, stop, words(data, at[k: stop + 1], fold)
        k = stop


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and where each document's begin; a document of fewer words has one run."""
    factor = constants(11, n)
    count = np.diff(w.first)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(runs)])
    size = len(w.hash)
    h = np.zeros(max(0, size - n + 1), U)
    for k in range(n):
        h += w.hash[k: size - n + 1 + k] * factor[k]
    doc = np.repeat(np.arange(len(count)), runs)
    place = w.first[:-1][doc] + np.arange(len(doc)) - first[:-1][doc]
    out = np.zeros(len(doc), U)
    whole = count[doc] >= n
    out[whole] = h[place[whole]]
    for d in np.flatnonzero((count > 0) & (count < n)):
        own = w.hash[w.first[d]: w.first[d + 1]]
        out[first[d]] = (own * factor[: len(own)]).sum(dtype=U) + U(len(own))
    return mix(out), first
