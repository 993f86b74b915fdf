"""Vectorised word and shingle hashing over Arrow string arrays.

A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``. As these are
ASCII, working on the UTF-8 bytes cuts at the same places as working on code points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)  # odd, so that products with it lose nothing modulo 2**64
_MIX = (U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53))
#: bytes of a word that are hashed eight at a time for all words at once; longer words are hashed one by one
SHORT = 64
#: keeps the low 0 to 8 bytes of eight
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: bytes hashed at once; longer batches are cut between rows, a longer row has a slice of its own
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * _MIX[0]
    x = x ^ (x >> U64(33))
    x = x * _MIX[1]
    return x ^ (x >> U64(33))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 row bounds in them; nulls are empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if a.null_count:
        a = a.fill_null("")
    a = a.cast(pa.large_string())
    _, off, data = a.buffers()
    bounds = np.frombuffer(off, np.int64, len(a) + 1, a.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES):
    """(first, end) row ranges of at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, bounds: np.ndarray, lower: bool = False):
    """Word starts, ends (byte places) and the n + 1 bounds of each row's words."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    text = ~SPACE[raw]
    first = text.copy()
    first[1:] &= ~text[:-1]
    cut = bounds[1:-1]
    cut = cut[cut < n]
    first[cut] = text[cut]
    last = text.copy()
    last[:-1] &= ~text[1:]
    cut = cut[cut > 0]
    last[cut - 1] = text[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def heads(raw: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with padding, and as numbers the eight bytes from each place on."""
    text = np.zeros(len(raw) + 8, np.uint8)
    text[: len(raw)] = _LOWER[raw] if lower else raw
    return text, np.ndarray(len(raw) + 1, "<u8", text, 0, (1,))


def beginnings(eight: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the first ``size`` (up to eight) bytes of each of some ``heads``; different bytes, different hashes."""
    return mix((eight & KEEP[size]) ^ mix(np.array([size], U64)))


def _folded(live: np.ndarray, size: np.ndarray, step: int, part: Callable) -> np.ndarray:
    """Hashes of spans of which ``live`` are short: their parts go through the finaliser one after another."""
    h = mix(size.astype(U64) * _STEP)
    at = 0
    while len(live):
        h[live] = mix((h[live] ^ part(live, at)) * _STEP)
        at += step
        live = live[size[live] > at]
    return h


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time go through the finaliser, so no sum or product of bytes alone decides a hash.
    """
    text, eight = heads(raw, lower)
    size = ends - starts
    h = _folded(np.flatnonzero(size <= SHORT), size, 8, lambda live, at: eight[starts[live] + at] & KEEP[np.minimum(size[live] - at, 8)])
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return h


def name_hashes(names: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for spans of 64-bit numbers."""
    size = ends - starts
    h = _folded(np.flatnonzero(size <= SHORT), size, 1, lambda live, at: names[starts[live] + at])
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(names[starts[i] : ends[i]].tobytes())
    return h


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int):
    """Hashes of k consecutive words and their row bounds.

    A row with 1 to k - 1 words has one shingle, its whole sequence; a row without words has none.
    """
    n = np.diff(bounds)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=out[1:])
    row = np.repeat(np.arange(len(n)), many)
    place = bounds[row] + np.arange(out[-1]) - out[row]
    left = n[row]
    h = np.zeros(len(place), U64)
    for j in range(k):
        inside = left > j
        at = np.minimum(place + j, max(len(hashes) - 1, 0))
        h = h * _STEP + np.where(inside, hashes[at], U64(j + 7)) if len(hashes) else h
    return mix(h), out
