"""Elias-Fano sequences and an n-gram trie made of them, over numpy arrays that may be memory-mapped."""

from __future__ import annotations

from pathlib import Path

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value.

    The low bits of each value are packed; the high bits stand in unary in a bit vector with counts per
    64-bit word, so that any value and the run of values with given high bits are found by select.
    """

    PARTS = ("low", "high", "ones")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        universe = universe if n else 0
        bits = max(0, min(56, int(np.log2(max(universe, 1) / n)))) if n else 0
        parts = [np.zeros(0, np.uint8)]
        for at in range(0, n, 1 << 16):  # whole bytes at each cut, as the step is a multiple of 8
            some = v[at : at + (1 << 16)]
            parts.append(np.packbits(((some[:, None] >> np.arange(bits, dtype=np.uint64)) & _ONE).astype(np.uint8).reshape(-1), bitorder="little"))
        low = np.concatenate([*parts, np.zeros(9, np.uint8)])
        top = v >> np.uint64(bits)
        size = n + int(universe >> bits) + 2
        flags = np.zeros((size + 63) // 64 * 64, np.uint8)
        flags[top.astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return cls(n, bits, low, high, ones)

    def _select(self, i: np.ndarray, zero: bool) -> np.ndarray:
        """Positions of the i-th set (or clear) bits."""
        before = self.zeros if zero else self.ones
        word = np.searchsorted(before, i, side="right") - 1
        x = np.asarray(self.high[word])
        x = ~x if zero else x
        left = (i - before[word]).astype(np.int64)
        at = np.zeros(len(word), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            part = (x >> at) & np.uint64((1 << width) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            skip = left >= count
            left = np.where(skip, left - count, left)
            at = np.where(skip, at + np.uint64(width), at)
        return word * 64 + at.astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        off = i * self.bits
        eight = np.asarray(self.low[(off >> 3)[:, None] + np.arange(8)])
        return (np.ascontiguousarray(eight).view(np.uint64)[:, 0] >> (off & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, False) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least index in first .. last - 1 with a value of x or more, else last."""
        x = np.asarray(x, np.uint64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        low = x & np.uint64((1 << self.bits) - 1) if self.bits else np.zeros(len(x), np.uint64)
        a = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - h + 1, 0)
        b = self._select(h, True) - h
        a, b = np.clip(a, first, last), np.clip(b, first, last)
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        return a

    def save(self, folder: Path, name: str) -> None:
        np.save(folder / f"{name}-head.npy", np.array([self.n, self.bits]))
        for part in self.PARTS:
            np.save(folder / f"{name}-{part}.npy", getattr(self, part))

    @classmethod
    def load(cls, folder: Path, name: str) -> EliasFano:
        n, bits = np.load(folder / f"{name}-head.npy").tolist()
        return cls(n, bits, *(np.load(folder / f"{name}-{part}.npy", mmap_mode="r") for part in cls.PARTS))


class TrieLevel:
    """Children of the nodes of the level above.

    A child's id counts within its context: the sequence holds context * 2^32 + id, the pointers say
    where a context's children start, and a lookup is a successor search between its pointers. Beside each child
    stand its quantised values, each in one byte with a step and an offset of its own.
    """

    def __init__(self, children: EliasFano, pointers: EliasFano, codes: dict[str, np.ndarray], scales: dict[str, tuple[float, float]]):
        self.children, self.pointers, self.codes, self.scales = children, pointers, codes, scales

    @classmethod
    def build(cls, parents: np.ndarray, ids: np.ndarray, n_parents: int, values: dict[str, np.ndarray]) -> TrieLevel:
        """Children sorted by (parent, id), without repeats."""
        codes, scales = {}, {}
        for name, v in values.items():
            least, most = (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)
            step = (most - least) / 255 or 1.0
            codes[name], scales[name] = np.rint((v - least) / step).astype(np.uint8), (least, step)
        key = (parents.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
        starts = np.searchsorted(parents, np.arange(n_parents + 1))
        return cls(EliasFano.build(key, max(n_parents, 1) << 32), EliasFano.build(starts, len(ids) + 1), codes, scales)

    def find(self, parents: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Index of each child, or -1."""
        if not self.children.n:
            return np.full(len(parents), -1, np.int64)
        first, last = (self.pointers.get(parents + k).astype(np.int64) for k in (0, 1))
        x = (parents.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
        at = self.children.successor(x, first, last)
        hit = at < last
        hit[hit] = self.children.get(at[hit]) == x[hit]
        return np.where(hit, at, -1)

    def value(self, name: str, at: np.ndarray) -> np.ndarray:
        """Values by index; 0 for -1."""
        least, step = self.scales[name]
        if not self.children.n:
            return np.zeros(len(at))
        return np.where(at >= 0, np.asarray(self.codes[name][np.maximum(at, 0)]) * step + least, 0.0)

    def mapped(self, folder: Path, name: str) -> TrieLevel:
        """The same level with its arrays written to files and mapped."""
        self.children.save(folder, f"{name}-children")
        self.pointers.save(folder, f"{name}-pointers")
        codes = {}
        for k, v in self.codes.items():
            np.save(folder / f"{name}-{k}.npy", v)
            codes[k] = np.load(folder / f"{name}-{k}.npy", mmap_mode="r") if len(v) else v
        return TrieLevel(EliasFano.load(folder, f"{name}-children"), EliasFano.load(folder, f"{name}-pointers"), codes, self.scales)
