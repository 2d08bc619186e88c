"""Words of a batch of texts as numpy arrays: where they lie and their 64-bit hashes.

A word is a run of bytes other than space and tab to carriage return. Hashing works on the UTF-8 bytes of the
Arrow column, in blocks of bounded size cut at white space, so a very long text needs no more memory at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15) | U(1)
#: Bytes hashed at once, about; and bytes of texts handed out at once.
BLOCK, SLICE = 1 << 18, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix: a bijection that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 at least, and their inverses; kept up to the usual block's length."""
    if _kept and len(_kept[0]) >= n:
        return _kept[0], _kept[1]
    out = []
    for b in (BASE, U(_inverse(int(BASE)))):
        p = np.full(max(n, BLOCK + 4097), b, U)
        p[0] = 1
        out.append(np.cumprod(p, out=p))
    if len(out[0]) <= 2 * BLOCK:
        _kept[:] = out
    return out[0], out[1]


BYTE = mix(np.arange(1, 257, dtype=U))  # a byte's value in the polynomial


class Words(NamedTuple):
    """first: of each text, its first word's number (one more at the end); start, end: bytes within its text."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def is_space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def _block(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words in b."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~is_space(b)
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, back = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, U)
    np.cumsum(BYTE[b] * power[: len(b)], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U))


def words_of(buffer: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts that lie one after the other in buffer, between offsets."""
    base, stop = int(offsets[0]), int(offsets[-1])
    starts, ends, hashes = [], [], []
    cuts = offsets[1:-1] - base
    at = base
    while at < stop:
        to = min(stop, at + BLOCK)
        while to < stop:  # back to a white space, or on to the next
            gaps = np.flatnonzero(is_space(buffer[max(at, to - 4096) : to]))
            if len(gaps):
                to = max(at, to - 4096) + int(gaps[-1]) + 1
                break
            edge = int(np.searchsorted(offsets, to))
            to = min(stop, to + BLOCK, int(offsets[edge]) if edge < len(offsets) else stop)
            if to in (stop, int(offsets[edge]) if edge < len(offsets) else stop):
                break
        b = buffer[at:to]
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
        s, e, h = _split(b, cuts + base - at)
        starts.append(s + (at - base))
        ends.append(e + (at - base))
        hashes.append(h)
        at = to
    start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
    first = np.searchsorted(start, offsets - base)
    text = np.repeat(offsets[:-1] - base, np.diff(first))
    return Words(first, start - text, end - text, np.concatenate(hashes) if hashes else np.zeros(0, U))


def _split(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of b where a text ends at each cut, even within a run of other bytes."""
    cuts = cuts[(cuts > 0) & (cuts < len(b))]
    cuts = cuts[~is_space(b[cuts]) & ~is_space(b[cuts - 1])] if len(cuts) else cuts
    if not len(cuts):
        return _block(b)
    cuts = np.unique(cuts)
    s, e, h = _block(np.insert(b, cuts, 32))
    return s - np.searchsorted(cuts + np.arange(len(cuts)), s), e - np.searchsorted(cuts + np.arange(len(cuts)), e, side="left"), h


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, buffer, offsets) of a string column, null as empty, at most SLICE bytes or one row at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        yield i, j, buffer, offsets[i : j + 1]
        i = j


def shingle_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): the k-word shingles of each text; of a text with fewer words, all of them as one."""
    counts = np.diff(w.first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], n)
    length = np.repeat(np.minimum(counts, k), n)
    h = length.astype(U) * BASE
    for j in range(k):
        live = j < length
        h = np.where(live, mix(h + w.hash[np.minimum(at + j, max(0, len(w.hash) - 1))] * (U(2) * U(j) + U(1))), h) if len(h) else h
    return first, h
