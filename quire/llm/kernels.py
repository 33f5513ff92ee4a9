"""Numpy kernels over many texts at once: flat bytes, words, hashes.

Texts of an Arrow column are handled as one flat byte array with offsets, so that no Python
object is made for a word. Hashes are 64 bits wide; two different words or word windows of a
corpus are taken for equal only where these collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words of letters and digits: 0-9, a-z and all of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words between white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets of the texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def blocks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes, which bound the memory of a kernel."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Values that stay in a core's cache over the steps of a sum.
CACHED = 1 << 14
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        have = _tables[base] = np.cumprod(have, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values (that of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of which two give the polynomial hash of any span."""
    sums, scale = np.zeros(len(data) + 1, U64), powers(_BASE, len(data))
    for i in range(0, len(data), CACHED):
        part = sums[i + 1 : i + 1 + CACHED]
        part[:] = data[i : i + CACHED]
        part += U64(1)
        part *= scale[i : i + CACHED]
        part[:1] += sums[i : i + 1]
        np.cumsum(part, out=part)
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _finished(sums[ends] - sums[starts], starts, ends, len(sums))


def _finished(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of spans from their sums, ``n`` being one more than all bytes."""
    sums *= powers(_INVERSE, n)[starts]
    sums += (ends - starts).astype(U64)
    return mix(sums)


def upper(data: np.ndarray) -> np.ndarray:
    """Whether bytes are A-Z."""
    return (data - np.uint8(65)) < np.uint8(26)


def lowered(data: np.ndarray) -> np.ndarray:
    """``LOWER[data]`` by arithmetic, which takes a tenth of the time."""
    return data + upper(data).view(np.uint8) * np.uint8(32)


def nonspace(data: np.ndarray) -> np.ndarray:
    """``NONSPACE[data]`` by arithmetic."""
    return (data != 0x20) & ((data - np.uint8(9)) > np.uint8(4))


class LowerSums:
    """Hashes of spans in lower case from the ``prefix_sums`` of bytes as they are: only upper-case letters add to these."""

    def __init__(self, data: np.ndarray, sums: np.ndarray):
        is_upper = upper(data)
        self.sums, self.n_upper, at = sums, np.zeros(len(data) + 1, np.int32), np.flatnonzero(is_upper)
        np.cumsum(is_upper, dtype=np.int32, out=self.n_upper[1:])
        self.more = np.zeros(len(at) + 1, U64)
        np.cumsum(powers(_BASE, len(data))[at] * U64(32), out=self.more[1:])

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, low, high = self.sums[ends] - self.sums[starts], self.n_upper[starts], self.n_upper[ends]
        some = np.flatnonzero(high > low)
        out[some] += self.more[high[some]] - self.more[low[some]]
        return _finished(out, starts, ends, len(self.sums))


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the n+1 offsets of each text's words in them."""
    return runs(table[data], off)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words`` of bytes that are ``inside`` of one."""
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = off[:-1][off[:-1] < len(inside)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[heads[heads > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive values; len(h)-k+1 of them. Windows across texts are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * U64(_BASE) + h[i : i + n]
    return mix(out)


def owners(off: np.ndarray) -> np.ndarray:
    """The text of each item."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
