"""Words and word n-grams of Arrow string columns as 64-bit hashes, in numpy.

A word is a run of ``[0-9a-z]`` or of any character beyond ASCII, after A-Z is
lower-cased: in UTF-8 the latter are the bytes of 0x80 and more, so words can
be found byte by byte, whole batches at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are cut to pieces of about so many bytes (whole rows): arrays stay in the cache.
SEGMENT = 1 << 18

_LOWER = np.zeros(256, np.uint8)
_LOWER[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_LOWER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[0x80:] = np.arange(0x80, 256)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: The base of n-grams over word hashes.
GRAM_BASE = 0xD6E8FEB86659FD93 | 1

_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; kept for the usual sizes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 4096)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """The words of rows lo to hi of a batch."""

    lo: int
    hi: int
    low: np.ndarray  # lower-cased bytes, 0 where no word is
    start: np.ndarray  # of each word, in low
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words bounds[i] to bounds[i + 1] belong to row lo + i
    offsets: np.ndarray  # bytes offsets[i] to offsets[i + 1] of low are row lo + i

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The row (from 0) of each word."""
        return np.repeat(np.arange(self.hi - self.lo, dtype=np.int32), self.counts)

    def text(self, first: int, n: int) -> bytes:
        """Words first to first + n, joined by spaces."""
        raw = self.low[self.start[first] : self.end[first + n - 1]].tobytes()
        return b" ".join(x for x in raw.split(b"\0") if x)


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string array; null rows are empty."""
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def segments(off: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``most`` bytes; a longer row stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(texts: pa.Array) -> Iterator[Words]:
    """All rows of ``texts``, segment by segment."""
    if len(texts) == 0:
        return
    off, data = string_buffers(texts)
    for lo, hi in segments(off):
        rows = off[lo : hi + 1] - off[lo]
        low = _LOWER[data[off[lo] : off[hi]]]
        n = len(low)
        if n == 0:
            none = np.zeros(0, np.int64)
            yield Words(lo, hi, low, none, none, np.zeros(0, U64), np.zeros(hi - lo + 1, np.int64), rows)
            continue
        inside = low != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = rows[:-1][rows[:-1] < n]
        begins[edge] = inside[edge]
        start = np.flatnonzero(begins)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        last = rows[1:] - 1
        last = last[last >= 0]
        closes[last] = inside[last]
        end = np.flatnonzero(closes) + 1
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(low * _powers_of(_BASE, n), out=total[1:])
        hashes = mix((total[end] - total[start]) * _powers_of(_INVERSE, n)[start])
        yield Words(lo, hi, low, start, end, hashes, np.searchsorted(start, rows), rows)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words: len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, U64)
    parts, size, have = None, 0, (h, 1)
    left = n
    while left:  # n as a sum of powers of two
        if left & 1:
            if parts is None:
                parts, size = have
            else:
                grown = len(h) - size - have[1] + 1
                parts = parts[:grown] * U64(pow(GRAM_BASE, have[1], 1 << 64)) + have[0][size : size + grown]
                size += have[1]
        left >>= 1
        if left:
            g, k = have
            have = (g[: len(g) - k] * U64(pow(GRAM_BASE, k, 1 << 64)) + g[k:], 2 * k)
    return mix(parts)


def row_grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of each row, and their bounds by row.

    A row of fewer than n words, but not none, has one gram of all its words.
    """
    counts = w.counts
    grams = np.maximum(counts - n + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = gram_hashes(w.hash, n)
    r = w.rows()
    whole = whole[r[: len(whole)] == r[n - 1 :]] if len(whole) else whole
    bounds = np.zeros(len(counts) + 1, np.int64)
    if not len(short):
        np.cumsum(grams, out=bounds[1:])
        return whole, bounds
    at = np.concatenate([[0], np.cumsum(grams)])[short]
    few = [gram_hashes(w.hash[w.bounds[i] : w.bounds[i + 1]], int(counts[i]))[0] for i in short]
    grams[short] = 1
    np.cumsum(grams, out=bounds[1:])
    return np.insert(whole, at, np.array(few, U64)), bounds
