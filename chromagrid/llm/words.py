"""Word boundaries and 64-bit word hashes of whole Arrow text columns, in numpy.

A hash is a sum of random table values times powers of an odd number, taken
from prefix sums, so that every word of a batch is hashed by array operations.
Arithmetic is modulo 2**64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
TABLE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
STEP = int(_RNG.integers(1, 2**63)) * 2 + 1
BACK = pow(STEP, -1, 2**64)
#: Bytes that are hashed at a time (a longer word is hashed whole).
SPAN = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII but letters and digits; bytes of longer characters belong to words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) <= n:
        size = max(n + 1, 2 * len(_pow))
        with np.errstate(over="ignore"):
            a, b = np.full(size, STEP, np.uint64), np.full(size, BACK, np.uint64)
            a[0] = b[0] = 1
            _pow, _inv = np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row starts (rows + 1 numbers); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset)
    size = int(at[-1] - at[0])
    raw = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def bounds(raw: np.ndarray, at: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each row (rows + 1 numbers)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    gap = gaps[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    begin, stop = ~gap, ~gap
    begin[1:] &= gap[:-1] | first[1:-1]
    stop[:-1] &= gap[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, at)


def hashes(raw: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """For each array of ends, the hashes of the spans from ``starts``; spans of a
    word must lie within it.  The last array of ends holds the full words."""
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    last, i, n = ends[-1], 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(last, lo + SPAN, side="right")))
            hi = int(last[j - 1])
            up, down = _powers(hi - lo)
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(TABLE[raw[lo:hi]] * up[: hi - lo], dtype=np.uint64, out=sums[1:])
            s = starts[i:j] - lo
            for o, e in zip(out, ends, strict=True):
                o[i:j] = mix((sums[e[i:j] - lo] - sums[s]) * down[s] + (e[i:j] - starts[i:j]).astype(np.uint64))
            i = j
    return out


def hashed(column: pa.Array, lower: bool = False, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and the index of the first of each row."""
    raw, at = utf8(column)
    if lower:
        raw = LOWER[raw]
    starts, ends, first = bounds(raw, at, gaps)
    return hashes(raw, starts, ends)[0] if len(starts) else np.zeros(0, np.uint64), first


def rolling(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` numbers of ``h`` (len(h) - width + 1 of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        h = mix(h + np.uint64(salt)) if salt else h
        for k in range(width):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[k : k + n]
    return mix(out)
