"""Vectorised word handling shared by the text operators.

A batch of texts is cut into words on raw UTF-8 buffers with numpy and dictionary-encoded by Arrow, so
the work per word is a table lookup and Python code runs only once per distinct word of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: blank and 0x09 to 0x0D.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Text bytes handled at once by a Python worker; a single longer text makes a batch of its own.
BATCH_BYTES = 4 << 20

try:  # only where the C library has it
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _trim = None

_ODD = np.uint64(0xD6E8FEB86659FD93)
_OF_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a batch: codes[starts[i]:starts[i + 1]] index ``distinct`` for text i."""

    codes: np.ndarray
    starts: np.ndarray
    distinct: pa.Array

    @property
    def n_texts(self) -> int:
        return len(self.starts) - 1

    def owners(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(self.n_texts, dtype=np.int64), np.diff(self.starts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each distinct word: random numbers of its bytes times powers of an odd number, scrambled."""
        n = len(self.distinct)
        if not n:
            return np.zeros(0, np.uint64)
        _, offsets, data = self.distinct.buffers()
        off = np.frombuffer(offsets, np.int32)[self.distinct.offset : self.distinct.offset + n + 1].astype(np.int64)
        sizes = np.diff(off)
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _ODD)]))
        place = np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], sizes)
        each = _OF_BYTE[np.frombuffer(data, np.uint8)[off[0] : off[-1]]] * powers[place]
        return mix(np.add.reduceat(each, off[:-1] - off[0]) ^ mix(sizes.astype(np.uint64)))


def as_array(column) -> pa.Array:
    """One contiguous string array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.string()).fill_null("")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each text in them."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int32, count=texts.offset + n + 1)[texts.offset :].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def cut(body: np.ndarray, off: np.ndarray, blanks: bytes = BLANKS, lower: bool = False) -> Words:
    """Words between blanks, never across the end of a text."""
    table = np.zeros(256, bool)
    table[list(blanks)] = True
    sep = table[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[off] = True
    word = ~sep
    before = edge[:-1].copy()
    before[1:] |= sep[:-1]
    first = np.flatnonzero(word & before)
    after = edge[1:].copy()
    after[:-1] |= sep[1:]
    last = np.flatnonzero(word & after) + 1
    starts = np.searchsorted(first, off)
    letters = body[word]
    if lower:
        letters = _LOWER[letters]
    where = np.zeros(len(first) + 1, np.int32)
    np.cumsum(last - first, out=where[1:])
    all_words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(where), pa.py_buffer(letters)])
    coded = all_words.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts.astype(np.int64), coded.dictionary)


def words(texts: pa.Array, blanks: bytes = BLANKS, lower: bool = False) -> Words:
    return cut(*raw(texts), blanks, lower)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = raw(as_array(batch.column(batch.schema.get_field_index(column))))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    tidy()


def tidy() -> None:
    """Give memory that a task has freed back to the system, as its worker serves other tasks next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Coded:
    """Ids of distinct strings by column, with a bound on the bytes kept."""

    def __init__(self, most_bytes: int = 24 << 20):
        self.most_bytes = most_bytes
        self.forget()

    def forget(self) -> None:
        #: Strings met so far, their ids one after another, and where each string's ids start.
        self.names, self.ids, self.off = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def trim(self) -> None:
        """Forget all if more is kept than the bound; the places of strings change with it."""
        if self.names.nbytes + self.ids.nbytes + self.off.nbytes > self.most_bytes:
            self.forget()

    def find(self, names: pa.Array, learn) -> np.ndarray:
        """Places of distinct strings. Those not met yet are learnt: ``learn`` gives, of an array of them, ids and the number of ids of each."""
        at = pc.index_in(names, self.names)
        place = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = names.take(pa.array(new))
            ids, sizes = learn(fresh)
            place[new] = len(self.names) + np.arange(len(new))
            self.names = pa.concat_arrays([self.names, fresh])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
        return place


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, one run after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """values[ragged(starts, lengths)], a block of runs at a time."""
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) <= block:
        return values[ragged(starts, lengths)]
    out, at = np.empty(int(lengths.sum()), values.dtype), 0
    for i in range(0, len(lengths), block):
        some = values[ragged(starts[i : i + block], lengths[i : i + block])]
        out[at : at + len(some)] = some
        at += len(some)
    return out


def split_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]], 0 for empty runs."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """Sorted values without repeats, by sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(w: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and where each text's runs start.

    A text of fewer words, but at least one, has a single run of all its words; an empty text has none.
    """
    h = (w.hashes() if hashes is None else hashes)[w.codes]
    n = np.diff(w.starts)
    runs = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = ragged(w.starts[:-1], runs)
    reach = np.repeat(np.minimum(n, size), runs)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        ok = reach > k
        if ok.all():
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
        else:
            out[ok] = mix(out[ok] * np.uint64(0x9E3779B97F4A7C15) + h[at[ok] + k])
    return out, np.concatenate([[0], np.cumsum(runs)])
