"""Vectorised views of a batch of texts: bytes, words and hashes without a Python loop over words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

#: Bytes handled at a time; arrays of a few dozen times this size exist for a moment.
PIECE = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32

#: Letters only: lower case, bytes outside ASCII stay, everything else separates.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def trim() -> None:
    """Give freed memory back to the system: a worker waits for its next task, whose memory counts too."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than rows); null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows whose bytes together stay under ``limit``, or one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


class Words:
    """The words of a run of rows: ``text`` has them joined by one space inside each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, mapping: np.ndarray = _LOWER):
        mapped = mapping[data]
        solid = mapped != 32
        first = np.zeros(len(mapped) + 1, bool)
        first[offsets] = True
        before = np.empty(len(mapped), bool)
        if len(mapped):
            before[0] = False
            before[1:] = solid[:-1]
        start = solid & (~before | first[:-1])
        at = np.flatnonzero(start)
        self.row = (np.searchsorted(offsets, at, "right") - 1).astype(np.int64)
        same = np.zeros(len(at), bool)
        same[1:] = self.row[1:] == self.row[:-1]
        # one space goes before every word but the first of its row
        rank = np.cumsum(solid, dtype=np.int64) + 0
        starts = rank[at] - 1 + np.cumsum(same)
        total = int(rank[-1]) if len(rank) else 0
        self.text = np.full(total + int(same.sum()), 32, np.uint8)
        word = np.cumsum(start, dtype=np.int64) - 1
        pos = np.flatnonzero(solid)
        spaces = np.cumsum(same)
        self.text[rank[pos] - 1 + spaces[word[pos]]] = mapped[pos]
        self.start = starts
        ends = np.empty(len(at), np.int64)
        ends[:-1] = starts[1:] - same[1:]
        if len(at):
            ends[-1] = len(self.text)
        self.end = ends
        self.rows = len(offsets) - 1

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end in ``text`` of each run of ``k`` words, or of all words of a shorter row."""
        n = len(self.row)
        count = np.bincount(self.row, minlength=self.rows)
        base = np.concatenate([[0], np.cumsum(count)])
        within = np.arange(n) - base[self.row]
        size = np.minimum(count, k)[self.row]
        ok = within + size <= count[self.row]
        i = np.flatnonzero(ok)
        return self.row[i], self.start[i], self.end[i + size[i] - 1]


def spans(data: np.ndarray, k: int, mapping: np.ndarray = _LOWER, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Cuts of one long text, each of about ``limit`` bytes and of whole words, that overlap in ``k`` - 1 words.

    Every run of ``k`` words lies in exactly one of them.  A cut is longer where fewer than ``k`` words fit.
    """
    n, at = len(data), 0
    solid = np.flatnonzero(mapping[data] != 32)
    last = int(solid[-1]) + 1 if len(solid) else 0
    del solid
    while True:
        size = limit
        while True:
            to = at + size
            if to >= last:
                yield at, n
                return
            part = mapping[data[at:to]] != 32
            begins = np.flatnonzero(part & ~np.concatenate([[False], part[:-1]]))
            ends = np.flatnonzero(~part & np.concatenate([[False], part[:-1]]))
            if len(ends) >= k:  # words that are whole
                break
            size *= 2
        yield at, at + int(ends[-1])
        at += int(begins[len(ends) - k + 1]) if k > 1 else int(ends[-1])


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """a, b, row (from 0) and hash of each shingle of rows a to b, by row; the arrays of a long text are made cut by cut."""
    for a, b in pieces(offsets):
        part, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b == a + 1 and len(part) > PIECE:
            found = []
            for i, j in spans(part, k):
                got = Words(part[i:j], np.array([0, j - i]))
                found.append(xxh64(got.text, *got.shingles(k)[1:]))
            h = np.concatenate(found)
            yield a, b, np.zeros(len(h), np.int64), h
        else:
            got = Words(part, cut)
            row, start, end = got.shingles(k)
            yield a, b, row, xxh64(got.text, start, end)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(text: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice of ``text``; slices under 32 bytes in numpy, longer ones one by one."""
    size = end - start
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        short = np.flatnonzero(size < 32)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded, (len(text) + 1, 8), (1, 1))

        def eight(at: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(words[at]).view(np.uint64).ravel()

        at, left = start[short].copy(), size[short].copy()
        h = np.uint64(seed) + P5 + left.astype(np.uint64)
        for _ in range(3):
            i = np.flatnonzero(left >= 8)
            if not len(i):
                break
            k = _rot(eight(at[i]) * P2, 31) * P1
            h[i] = _rot(h[i] ^ k, 27) * P1 + P4
            at[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        if len(i):
            k = (eight(at[i]) & np.uint64(0xFFFFFFFF)) * P1
            h[i] = _rot(h[i] ^ k, 23) * P2 + P3
            at[i] += 4
            left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(left >= 1)
            if not len(i):
                break
            h[i] = _rot(h[i] ^ (padded[at[i]].astype(np.uint64) * P5), 11) * P1
            at[i] += 1
            left[i] -= 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
        out[short] = h
    view = memoryview(np.ascontiguousarray(text))
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(view[start[i] : end[i]], seed)
    return out
