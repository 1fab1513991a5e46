"""Vectorised words, word hashes and n-gram hashes over the raw buffers of an Arrow string column.

No per-row Python: positions of words come from a byte class table, and hashes are polynomials with
random byte values, taken modulo 2**64 by prefix sums, so that a word costs a few numpy operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20260101))
#: A random 64-bit value for each byte.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
#: Odd bases of the polynomials, so that they can be divided by modulo 2**64.
WORD_BASE, GRAM_BASE, GRAM_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
CHUNK_BYTES = 4 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base][0][:n], _powers[base][1][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends in them (a null text is empty)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    at = np.frombuffer(off, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if off and len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes, or a single longer text."""
    _, at = buffers(texts)
    first, n = 0, len(texts)
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each text the range of its words (n + 1 offsets)."""
    solid = ~_IS_SPACE[raw]
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate(([False], solid[:-1]))))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span (in order, not overlapping); memory is bounded by ``piece`` bytes or the longest span."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + piece, "right")))
        p, inv = powers(WORD_BASE, int(ends[last - 1]) - base)
        total = np.cumsum(np.concatenate((np.zeros(1, dtype=np.uint64), values[raw[base : int(ends[last - 1])]] * p)), dtype=np.uint64)
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (total[e] - total[s]) * inv[s]
        first = last
    return mix(out + _U(1))


def grams(h: np.ndarray, k: int, base: int = GRAM_BASE) -> np.ndarray:
    """Hashes of the k-grams that start at each position of ``h`` (len(h) - k + 1 of them; none if shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    if k <= 12:
        factor = _U(1)
        for j in range(k):
            out += h[j : j + n] * factor
            factor = _U(int(factor) * base % (1 << 64))
        return mix(out)
    step = 1 << 18
    for first in range(0, n, step):
        last = min(n, first + step)
        part = h[first : last + k - 1]
        p, inv = powers(base, len(part))
        total = np.cumsum(np.concatenate((np.zeros(1, dtype=np.uint64), part * p)), dtype=np.uint64)
        out[first:last] = (total[k:] - total[:-k]) * inv[: last - first]
    return mix(out)


def hash_slices(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = GRAM_BASE_2, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each slice ``h[start:end]``; slices are in order of their starts and may overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(starts, low + piece, "right")))
        high = int(ends[first:last].max())
        p, inv = powers(base, max(high - low, 1))
        total = np.cumsum(np.concatenate((np.zeros(1, dtype=np.uint64), h[low:high] * p[: high - low])), dtype=np.uint64)
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (total[e] - total[s]) * inv[np.minimum(s, len(inv) - 1)]
        first = last
    return mix(out + (ends - starts).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[width - size : width - size + n]) if size < width else out[:n]
