"""Word and shingle hashing of Arrow string columns, vectorised with numpy.

A column is walked in blocks of about ``BLOCK`` bytes of UTF-8 (one document at least), so memory is bounded by
the block or by the longest document. Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
#: Bytes of text that are brought to lower case at once.
SLICE = 4 << 20
U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_BYTES = constants(256, 11)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES_LOWER = _BYTES[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_SLOTS = constants(64, 23)
_SHORT = constants(64, 37)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of documents lo..hi: hashes, first and last byte, and for each document the range of its words."""

    lo: int
    hi: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Hashes of each word's first n bytes (the whole word, if it is shorter)."""
        ends = np.minimum(self.ends, self.starts + n)
        return _close(self.sums, self.starts, ends)


def _close(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = _power(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * _SLOTS[0])


def hash_word(word: str, lower: bool = True) -> int:
    """The hash that ``words`` gives to this word."""
    w = next(words(pa.array([word]), lower=lower, separators=np.zeros(256, bool)))
    return int(w.hashes[0])


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(column) -> Iterator[tuple[int, pa.Array]]:
    """First row and rows of parts of a column of about ``SLICE`` bytes."""
    _, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1))
        yield lo, column.slice(lo, hi - lo)
        lo = hi


def lowered_words(column, separators: np.ndarray) -> Iterator[Words]:
    """Blocks of words of the column in lower case, by Unicode."""
    for base, part in slices(column):
        for w in words(pc.utf8_lower(part.cast(pa.large_string())), separators=separators):
            yield w._replace(lo=base + w.lo, hi=base + w.hi)


def words(column, lower: bool = True, separators: np.ndarray = SPACE) -> Iterator[Words]:
    """Blocks of words; ``lower`` folds A-Z only."""
    raw, offsets = buffers(column)
    table = _BYTES_LOWER if lower else _BYTES
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, side="right")) - 1)
        hi = min(hi, n)
        data, offs = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield _words(lo, hi, data, offs, table, separators)
        lo = hi


def _words(lo, hi, data, offs, table, separators) -> Words:
    n = len(data)
    inside = ~separators[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offs[:-1][offs[:-1] < n]] = False
        after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(table[data] * _power(n + 1)[0][:n], out=sums[1:])
    return Words(lo, hi, _close(sums, starts, ends), starts, ends, np.searchsorted(starts, offs), data, offs, sums)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k words, without regard to documents."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.full(m, U64(seed), U64)
    for j in range(k):
        out += hashes[j : m + j] * _SLOTS[j + 1]
    return mix(out)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document its distinct k-word shingles, sorted, and where they begin. A document of 1 to k-1 words has its
    whole sequence as one; a document without words has none."""
    count = np.diff(w.bounds)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], U64)
    full = count >= k
    if full.any():
        doc = np.repeat(np.arange(len(count)), count)
        g = grams(w.hashes, k)
        out[np.repeat(full, size)] = g[doc[: len(g)] == doc[k - 1 :]]
    for d in np.flatnonzero(~full & (count > 0)):
        h = w.hashes[w.bounds[d] : w.bounds[d + 1]]
        out[at[d]] = mix(np.array([(h * _SLOTS[1 : len(h) + 1]).sum(dtype=U64) ^ _SHORT[len(h)]], U64))[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][size > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]
