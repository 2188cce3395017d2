"""Numpy kernels that several operators share: an open-addressing hash map, ragged gathers, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class HashMap:
    """uint64 keys to int64 values, looked up and inserted by whole arrays."""

    def __init__(self, bits: int = 10):
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        self.bits, self.mask, self.count = bits, (1 << bits) - 1, 0
        self.keys = np.full(self.mask + 1, _FREE)
        self.values = np.full(self.mask + 1, -1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).view(np.int64)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't in the map yet."""
        if (self.count + len(keys)) * 3 > self.mask:
            old = self.keys != _FREE
            held = self.keys[old], self.values[old]
            self._alloc(max(self.bits, int((self.count + len(keys)) * 4).bit_length()))
            if len(held[0]):
                self.insert(*held)
        self.count += len(keys)
        at = self._slot(keys)
        while len(keys):  # all keys that still look for a slot step on together
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= self.keys[at] == _FREE
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            keys, values, at = keys[~take], values[~take], (at[~take] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        flat = keys.ravel()
        at = self._slot(flat)
        found = self.keys[at]
        out = np.where(found == flat, self.values[at], -1)
        seek = np.flatnonzero((found != flat) & (found != _FREE))
        while len(seek):
            at[seek] = (at[seek] + 1) & self.mask
            found = self.keys[at[seek]]
            hit = found == flat[seek]
            out[seek[hit]] = self.values[at[seek[hit]]]
            seek = seek[~hit & (found != _FREE)]
        return out.reshape(keys.shape)


class Grown:
    """An array that grows at its end; room doubles, so what is held is seldom copied."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        most = self.size + len(values)
        if most > len(self.room):
            room = np.zeros(max(most, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : most] = values
        self.size = most

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.size]


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + length], one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edges_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)))


#: A 64-bit number for each byte, and the odd base of the words' polynomial hash.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _SPREAD)
_BASE = 0xD6E8FEB86659FD93


class WordHasher:
    """64-bit hashes of the words in a buffer of UTF-8 texts, all at once.

    The hash of a word is a polynomial in its bytes, taken from running sums, and mixed; equal words have
    equal hashes wherever they stand.
    """

    def __init__(self, separators: bytes):
        self.gap = np.zeros(256, bool)
        self.gap[np.frombuffer(separators, np.uint8)] = True
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))
            self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse, np.uint64))))

    def __call__(self, raw: np.ndarray, edges: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, edges of each text's words) of texts raw[edges[k] : edges[k + 1]]."""
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        n = len(raw)
        if n + 1 > len(self.up):
            self._powers(2 * n)
        word = ~self.gap[raw]
        start = word.copy()
        end = word.copy()
        if n:
            start[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            cut = edges[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            start[cut] |= word[cut]  # a text's edge parts words
            end[cut - 1] |= word[cut - 1]
        first, last = np.flatnonzero(start), np.flatnonzero(end)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * self.up[:n])))
        hashes = mix((sums[last + 1] - sums[first]) * self.down[first] + (last - first).astype(np.uint64))
        return hashes, np.searchsorted(first, edges)


def shingle_hashes(words: np.ndarray, edges: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every run of size words, edges per text); a text of fewer words is one shingle, of none has none."""
    counts = np.diff(edges)
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_edges = edges_of(many)
    at = np.repeat(edges[:-1] - out_edges[:-1], many) + np.arange(int(out_edges[-1]))
    length = np.repeat(np.minimum(counts, size), many)
    out = length.astype(np.uint64)
    for k in range(size):
        inside = k < length
        follow = words[np.where(inside, at + k, at)] if len(at) else words[:0]
        out = np.where(inside, mix(out * _SPREAD + follow), out)
    return out, out_edges


def in_slices(texts: list[str], most: int = 1 << 22) -> Iterator[list[str]]:
    """The texts in runs of about most characters, so that a worker's arrays stay small."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _runs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts that together have at most most bytes, or one text."""
    ends, low = np.cumsum(lengths, dtype=np.int64), 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(ends, (int(ends[low - 1]) if low else 0) + most, "right")))
        yield low, high
        low = high


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of an Arrow column, null as empty, in runs of at most most bytes or one text; a run's strings are made when it is asked for."""
    for low, high in _runs(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), most):
        yield [t or "" for t in column.slice(low, high - low).to_pylist()]


def raw_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, edges) of such runs of texts, as they stand in the Arrow column."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    edges = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for low, high in _runs(np.diff(edges), most):
        yield raw[edges[low] : edges[high]], edges[low : high + 1] - edges[low]


def give_back() -> None:
    """Return the memory that a task has freed to the system: Spark keeps the worker for other operators' tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass
