"""Vectorised scanning of UTF-8 text columns: words, their hashes, shingle sets.

Everything works on the bytes of an Arrow string column, so no Python object is
made per word. Words are maximal runs of bytes outside ``\\x20`` and
``\\x09-\\x0D``; those are all ASCII, so cutting bytes cuts no character.
A word's hash is a 64-bit polynomial of its bytes, taken from prefix sums and
then mixed. Memory is bounded by PIECE bytes of text at a time, or by one
document's words if a document is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RAW = np.arange(1, 257, dtype=U)
_LOW = _RAW.copy()
_LOW[65:91] = _RAW[97:123]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n at least."""
    if not _powers or _powers[0].size < n:
        size = max(n, PIECE + 4096)
        _powers.clear()
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    a = np.sort(a)
    keep = np.ones(a.size, bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most ``limit`` bytes, or of one row."""
    lo, n = 0, offs.size - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of every word of the rows that ``offs`` cuts from ``buf``."""
    n, codes = buf.size, _LOW if lower else _RAW
    found, lo = [], 0
    while lo < n:
        hi = n
        if n > 2 * PIECE and lo + PIECE < n:
            hi = lo + PIECE
            while hi < n and not _SPACE[buf[hi]]:
                later = np.flatnonzero(_SPACE[buf[hi : hi + PIECE]])
                hi = hi + int(later[0]) if later.size else min(n, hi + PIECE)
        part = buf[lo:hi]
        black = ~_SPACE[part]
        cut = offs[(offs >= lo) & (offs <= hi)] - lo
        first, last = black.copy(), black.copy()
        first[1:] &= ~black[:-1]
        last[:-1] &= ~black[1:]
        at = cut[cut < part.size]
        first[at] = black[at]
        at = cut[cut > 0] - 1
        last[at] = black[at]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(part.size + 1)
        sums = np.zeros(part.size + 1, U)
        np.cumsum(codes[part] * up[: part.size], out=sums[1:])
        found.append((start + lo, end + lo, mix((sums[end] - sums[start]) * down[start])))
        lo = hi
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U)
    start, end, h = (np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found, strict=True))
    return start, end, np.searchsorted(offs, start, "right") - 1, h


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of every row, as 64-bit hashes ascending within the row.

    Returns the hashes of all rows and where each row's begin. A row of fewer
    words has its whole sequence as one shingle; one without words has none.
    """
    rows = offs.size - 1
    _, _, row, h = words(buf, offs, lower)
    count = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(count)])
    out, owner = [], []
    if h.size >= k:
        acc = h[: h.size - k + 1].copy()
        for j in range(1, k):
            acc = acc * U(0xD6E8FEB86659FD93) + h[j : h.size - k + 1 + j]
        whole = row[: h.size - k + 1] == row[k - 1 :]
        out.append(mix(acc[whole]))
        owner.append(row[: h.size - k + 1][whole])
    if (short := np.flatnonzero((count > 0) & (count < k))).size:
        acc, left = np.full(short.size, 0x5851F42D4C957F2D, U) * count[short].astype(U), count[short]
        for j in range(int(left.max())):
            has = left > j
            acc[has] = acc[has] * U(0xD6E8FEB86659FD93) + h[begin[short[has]] + j]
        out.append(mix(acc))
        owner.append(short)
    if not out:
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    sh, owner = np.concatenate(out), np.concatenate(owner)
    if len(out) > 1:
        order = np.argsort(owner, kind="stable")
        sh, owner = sh[order], owner[order]
    ends = np.cumsum(np.bincount(owner, minlength=rows))
    lo = 0
    for hi in ends.tolist():
        if hi - lo > 1:
            sh[lo:hi].sort()
        lo = hi
    keep = np.ones(sh.size, bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
    sh, owner = sh[keep], owner[keep]
    return sh, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


class Table:
    """Finds 64-bit hashes among given distinct ones, by open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(3 * max(1, keys.size)))))
        self.key, self.at = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int32)
        mask, left = (1 << self.bits) - 1, np.arange(keys.size)
        spot = (keys >> U(64 - self.bits)).astype(np.int64)
        while left.size:
            free = np.flatnonzero(self.at[spot[left]] < 0)
            take, where = np.unique(spot[left][free], return_index=True)
            won = left[free[where]]
            self.key[take], self.at[take] = keys[won], won
            left = np.setdiff1d(left, won, assume_unique=True)
            spot[left] = (spot[left] + 1) & mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash among the given ones, or -1."""
        mask, spot = (1 << self.bits) - 1, (h >> U(64 - self.bits)).astype(np.int64)
        out, left = np.full(h.size, -1, np.int32), np.arange(h.size)
        while left.size:
            at = self.at[spot]
            same = (at >= 0) & (self.key[spot] == h[left])
            out[left[same]] = at[same]
            go = (at >= 0) & ~same
            left, spot = left[go], (spot[go] + 1) & mask
        return out


def runs_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each run; codes are unsigned 64-bit, not 0."""
    up, down = powers(codes.size + 1)
    sums = np.zeros(codes.size + 1, U)
    np.cumsum(codes * up[: codes.size], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])
