"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64 bits wide and depend
on the word's bytes only, so they agree across batches, partitions and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_M1, _M2, _GOLD = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes of text that are hashed at a time; a longer text is a chunk of its own.
CHUNK = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(33))
    x = x * _M1
    x = x ^ (x >> U(33))
    x = x * _M2
    return x ^ (x >> U(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of an array (np.unique's hash table is many times slower on millions of integers)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


@dataclass
class Words:
    """Words of some consecutive texts; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    lanes: np.ndarray

    def hashes(self) -> np.ndarray:
        size = self.end - self.start
        h = mix(size.astype(np.uint64) + _GOLD)
        live, at = np.arange(len(size)), 0
        while len(live):
            left = size[live] - at
            lane = self.lanes[self.start[live] + at] & _MASK[np.minimum(left, 8)]
            h[live] = mix(h[live] * _GOLD ^ mix(lane + _GOLD))
            at += 8
            live = live[left > 8]
        return h

    def prefix(self, k: int) -> np.ndarray:
        """A hash of the first ``k`` (at most 8) bytes of each word."""
        n = np.minimum(self.end - self.start, k)
        return mix(self.lanes[self.start] & _MASK[n] ^ mix(np.array([k], np.uint64)))


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """``data``: the texts' bytes; ``offsets``: where each begins, and the end."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    wordy = ~_SEP[data]
    edge = np.zeros(n + 1, bool)
    if n:
        edge[1:n] = wordy[1:] != wordy[:-1]
        edge[0], edge[n] = wordy[0], wordy[-1]
        # a text's end also ends a word
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        both = cut[wordy[cut] & wordy[cut - 1]]
    else:
        both = np.empty(0, np.int64)
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    if len(both):
        both = distinct(both)
        start = np.sort(np.concatenate([start, both]))
        end = np.sort(np.concatenate([end, both]))
    first = np.searchsorted(start, offsets)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    lanes = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    return Words(data, start, end, first, lanes)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about CHUNK bytes."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that stay within a text, their texts, and each window's first word.

    A text of 1 to k - 1 words has one shingle, its whole sequence; one without words has none.
    """
    n = len(h)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    s = mix(h + _GOLD)
    full = s[: max(0, n - k + 1)].copy()
    for j in range(1, k):
        full = mix(full * _GOLD + h[j : j + len(full)])
    whole = np.flatnonzero(doc[: len(full)] == doc[k - 1 :]) if n >= k else np.empty(0, np.int64)
    out, owner, at = full[whole] if n >= k else np.empty(0, np.uint64), doc[whole], whole
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        x = s[first[short]].copy()
        for j in range(1, k - 1):
            more = np.flatnonzero(count[short] > j)
            x[more] = mix(x[more] * _GOLD + h[first[short[more]] + j])
        x = mix(x ^ (count[short].astype(np.uint64) << U(56)))
        out, owner, at = np.concatenate([out, x]), np.concatenate([owner, short]), np.concatenate([at, first[short]])
        order = np.argsort(owner, kind="stable")
        out, owner, at = out[order], owner[order], at[order]
    return out, owner, at


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row its sorted array of distinct shingle hashes (A-Z lower-cased)."""
    for _, _, data, offsets in chunks(column):
        w = split_words(data, offsets, True)
        s, owner, _ = shingles(w.hashes(), w.first, k)
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            yield distinct(s[bounds[i] : bounds[i + 1]])
