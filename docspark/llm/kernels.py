"""Vectorised byte and word kernels (numpy) shared by the text operators.

Texts arrive as one byte buffer plus offsets, so a kernel handles many
documents at a time and no Python code runs per word. A null text counts as
empty. Chunks bound the memory: one chunk holds about `CHUNK` bytes, or a single
longer document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_M = np.uint64(0xFFFFFFFFFFFFFFFF)

#: White space of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
#: Two independent rolling hashes: tables of the bytes, bases, and their powers and inverses so far.
_TABLES = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse modulo 2^64."""
    have = _powers[which]
    if len(have[0]) < n:
        for k, x in enumerate((_BASES[which], pow(_BASES[which], -1, 1 << 64))):
            p = np.full(n + n // 8, np.uint64(x), np.uint64)
            p[0] = 1
            have[k] = np.multiply.accumulate(p)
    return have[0][:n], have[1][:n]


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def chunks(buf: np.ndarray, offs: np.ndarray, limit: int = CHUNK):
    """Yield (first, last, bytes, offsets) for runs of whole documents."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by document) of the words `[^\x20\x09-\x0D]+`."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


class Rolling:
    """Hashes of any span of a buffer, from prefix sums of a polynomial mod 2^64; `which` of two independent ones."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        self.n = len(buf)
        p, self.inv = powers(self.n + 1, which)
        self.sums = np.empty(self.n + 1, np.uint64)
        self.sums[0] = 0
        x = _TABLES[which][buf]
        x *= p[: self.n]
        np.cumsum(x, out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inv[starts]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words of one run of word hashes (len(h) - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += h[j : j + n]
    return mix(out)


def distinct_sorted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, hash) pairs, sorted; `doc` must be ascending already."""
    if not len(h):
        return doc, h
    bounds = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
    h = h.copy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h[a:b].sort()
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    keep[bounds[:-1]] = True
    return doc[keep], h[keep]


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending 64-bit words as byte planes of their differences."""
    if not len(h):
        return b""
    d = h.copy()
    d[1:] -= h[:-1]
    d[0] = 0
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = d.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + int(h[0]).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    width = b[0]
    planes = np.frombuffer(b, np.uint8, offset=9).reshape(width, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :width] = planes.T
    x = d.view(np.uint64).ravel()
    x[0] = int.from_bytes(b[1:9], "little")
    return np.cumsum(x, dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    """Small counts in a byte each; larger ones follow in eight."""
    c = np.asarray(c, np.uint64)
    big = c >= 255
    return np.where(big, 255, c).astype(np.uint8).tobytes() + c[big].tobytes()


def unpack_counts(b: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(b, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(b, np.uint64, offset=n).astype(np.int64)
    return c


def cut_by_part(h: np.ndarray, parts: int) -> np.ndarray:
    """Offsets of the `parts` equal ranges of the 64-bit space in sorted hashes."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], dtype=object)
    edges = np.array([int(x) for x in edges], np.uint64) if parts > 1 else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))
