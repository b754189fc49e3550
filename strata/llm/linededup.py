"""Line dedup by an exact set-similarity join of lines.

A line is the set of its words between blanks. A line is removed if an earlier line, in order of doc_id
and line number, has a Jaccard similarity of ``similarity`` or more with it, whether or not that earlier line is itself
removed. Lines without a word are kept and compared with nothing.

1. Lines are cut once into word hashes and stored, a row for each document.
2. Rarity: counts of all words in a fixed table of hash buckets (a consistent order for any number of words), summed in two
   levels; it is the only thing broadcast besides a size-checked set of candidates.
3. Words of a line are ordered by rarity. Only the prefix that any similar line must share a word
   with is sent, with position, size and hashed parities, to the shard of the word. A word too
   frequent for one shard is dealt over cells, one for each pair of its blocks, so no group is unbounded.
4. A shard pairs lines that share a word if sizes, positions and parities allow the similarity.
   Equal lines were folded; of each line the shards keep the ``near`` closest earlier partners, and
   say so if there were more. Candidates are verified exactly, the closest first. A line that had more and was not settled
   is asked again without that bound, so no match is lost and a group of near copies isn't written out as all its pairs.
   That settles which lines go, and the pipeline needs no more.
5. ``line_join`` gives the whole join: each set of words gets its number of links (similar sets other than itself; equal lines
   are folded) and its class, the connected component of its links, named by the doc_id of its first line. No pair leaves a
   shard. Each round marks in tables of bits what the next one sends; a false mark costs a little work. The first round marks
   the sets and entries that have a partner. The second sends those entries with wider parities and a few of the words before
   them, and marks the entries that still have a partner and share none of these with it. The third sends those with all words of
   their sets: a shard verifies every pair whose rarest common word it has, so each pair counts once, and returns a row for
   each set: its links, whether one is earlier, and the least set of its component there. Components of these rows are the classes.

Word hashes are 32-bit within a pair and set hashes 64-bit. Nulls count as empty texts. A null doc_id comes
first. Repeated doc_ids are ordered by their stored row; a later equal row loses all its lines. Very long lines are compared like any.
Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.components import components
from strata.llm.shared import free_names, small_batches, stored
from strata.llm.text import as_array, cut, mix, pieces, ragged, raw, sorted_distinct, tidy

SIMILARITY = 0.8
BUCKET_BITS = 22
SLICES = 64
HOT = 4096
NEAR = 12
TRIED = 1
LONG = 64
KNOWN_MOST = 1_000_000
MARK_BITS = 28
WIDE = 4
AHEAD = 3
VERIFIED = 4_000_000

LINES = "doc_id bigint, rid bigint, text_hash bigint, n_lines int, line_no binary, sets binary, sizes binary, words binary"
_ENTRY = np.dtype([("word", "<u4"), ("cell", "<u4"), ("set", "<i8"), ("sketch", "<u8"), ("sketch2", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("line", "<i4"), ("n", "<i4"), ("at", "<i4")])
_FIRST = np.iinfo(np.int64).min


def line_sets(docs: DataFrame) -> DataFrame:
    """A row of LINES for each document: set hash, size and sorted 32-bit word hashes of each line with words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").withColumn("rid", F.monotonically_increasing_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=3 << 20):
            body, off = raw(as_array(b.column(2)))
            ends = np.flatnonzero(body == 10) + 1
            edges = sorted_distinct(np.concatenate([ends, off]))
            w = cut(body, edges)
            line = np.repeat(np.arange(len(edges) - 1), np.diff(w.starts))
            h = w.hashes()
            short = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            key = sorted_distinct(line.astype(np.uint64) << np.uint64(32) | short[w.codes].astype(np.uint64))
            line, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            size = np.bincount(line, minlength=len(edges) - 1)
            full = np.flatnonzero(size)
            starts = np.concatenate([[0], np.cumsum(size[full])])
            total = np.add.reduceat(mix(word.astype(np.uint64) + np.uint64(1)), starts[:-1]) if len(full) else np.zeros(0, np.uint64)
            sets = mix(total ^ mix(size[full].astype(np.uint64))).view(np.int64)
            begin = edges[:-1]
            doc = np.searchsorted(off, begin[full], side="right") - 1
            first_line = np.searchsorted(begin, off)
            number = (full - first_line[doc]).astype(np.int32)
            at = np.searchsorted(doc, np.arange(len(off)))
            sizes = size[full].astype(np.int32)
            n_lines = pa.array((np.diff(np.searchsorted(ends, off, side="right")) + 1).astype(np.int32), pa.int32())

            def blobs(x: np.ndarray, bounds: np.ndarray) -> pa.Array:
                return pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())

            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(1), n_lines, blobs(number, at), blobs(sets, at), blobs(sizes, at), blobs(word, starts[at])], names=["doc_id", "rid", "text_hash", "n_lines", "line_no", "sets", "sizes", "words"])

    return rows.mapInArrow(work, LINES)


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 2500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, to bound a worker's memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    tidy()


def _joined(column: pa.Array, dtype) -> np.ndarray:
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data[off[0] : off[-1]] if data is not None else b"", dtype)


def rarity(lines: DataFrame) -> np.ndarray:
    """Of each bucket of word hashes the number of lines with such words, on a scale of 0 to 255."""
    width = (1 << BUCKET_BITS) // SLICES

    def packed(x: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(np.minimum(x, np.iinfo(np.uint32).max).astype("<u4").tobytes())

    def unpacked(blob: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            total += np.bincount(_joined(b.column(0), np.uint32) >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES), pa.int32()), pa.array(np.full(SLICES, TaskContext.get().partitionId()), pa.int32()), pa.array([packed(x) for x in total.reshape(SLICES, width)], pa.binary())], names=["slice", "task", "counts"])

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for x in f["counts"]:
            total += unpacked(x)
        return pd.DataFrame({"slice": [f["slice"].iloc[0]], "task": [f["task"].iloc[0] // 64], "counts": [packed(total)]})

    shape = "slice int, task int, counts binary"
    parts = lines.select("words").mapInArrow(count, shape)
    parts = parts.withColumn("group", F.expr("cast(task div 64 as int)")).groupBy("slice", "group").applyInPandas(add, shape)
    got = parts.groupBy("slice").applyInPandas(add, shape).select("slice", "counts").collect()
    out = np.zeros((SLICES, width), np.uint64)
    for r in got:
        out[r["slice"]] = unpacked(r["counts"])
    return scaled(out.reshape(-1))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts up to 63 as they are, larger ones by their logarithm; at or over HOT from 64 + 8 * log2(HOT / 64)."""
    c = counts.astype(np.float64)
    return np.where(c < 64, c, np.minimum(255, 64 + np.floor(4 * np.log2(np.maximum(c, 64) / 64)))).astype(np.uint8)


def _count_of(level: np.ndarray) -> np.ndarray:
    """The largest count of a level."""
    x = level.astype(np.float64)
    return np.where(x < 64, x, 64 * 2 ** ((x - 63) / 4))


def least_overlap(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (n + m) - 1e-9).astype(np.int64)


def sketches(word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 parities of each line, each flipped by its words: two lines differ in no more parities than words.

    Lines of more than LONG words get 64 others as well; short ones have 0 there.
    """
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h, starts = mix(word.astype(np.uint64)), np.cumsum(sizes) - sizes
    one = np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), h & np.uint64(63)), starts)
    two = np.zeros(len(sizes), np.uint64)
    long = np.flatnonzero(sizes > LONG)
    if len(long):
        at = ragged(starts[long], sizes[long])
        two[long] = np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), h[at] >> np.uint64(58)), np.cumsum(sizes[long]) - sizes[long])
    return one, two


def _dealt(sets: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block of each set in the groups of words of the levels, and the number of blocks."""
    blocks = np.maximum(1, np.ceil(_count_of(level) / HOT)).astype(np.int64)
    return (mix(sets.view(np.uint64)) >> np.uint64(20)).astype(np.int64) % blocks, blocks


def entries(doc: np.ndarray, rid: np.ndarray, line: np.ndarray, sets: np.ndarray, sizes: np.ndarray, word: np.ndarray, levels: np.ndarray, t: float, buckets: np.ndarray | None = None) -> np.ndarray:
    """Prefix entries of lines, dealt over cells if hot; words that only one line has, or that are not in ``buckets``, are left out."""
    owner = np.repeat(np.arange(len(sets)), sizes)
    level = levels[word >> np.uint32(32 - BUCKET_BITS)]
    starts = np.cumsum(sizes) - sizes
    sketch, sketch2 = sketches(word, sizes)
    order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | (level.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64))
    word, level = word[order], level[order]
    at = np.arange(len(word)) - starts[owner]
    prefix = sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + 1
    keep = (at < prefix[owner]) & (level > 1)
    if buckets is not None:
        keep &= buckets[word >> np.uint32(32 - BUCKET_BITS)]
    word, level, owner, at = word[keep], level[keep], owner[keep], at[keep]
    mine, blocks = _dealt(sets[owner], level)
    source = np.repeat(np.arange(len(word)), blocks)
    other = ragged(np.zeros(len(word), np.int64), blocks)
    a, b = np.minimum(mine[source], other), np.maximum(mine[source], other)
    out = np.zeros(len(source), _ENTRY)
    out["word"], out["cell"] = word[source], a * blocks[source] + b
    o = owner[source]
    out["set"], out["sketch"], out["sketch2"], out["doc"], out["rid"], out["line"], out["n"], out["at"] = sets[o], sketch[o], sketch2[o], doc[o], rid[o], line[o], sizes[o], at[source]
    return out


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """doc (null first), rid, line numbers, sets, sizes and words of a batch of LINES."""
    line, sets, sizes, word = (_joined(b.column(b.schema.get_field_index(c)), t) for c, t in (("line_no", np.int32), ("sets", np.int64), ("sizes", np.int32), ("words", np.uint32)))
    n = np.fromiter((len(x) // 4 for x in b.column(b.schema.get_field_index("line_no")).to_pylist()), np.int64, b.num_rows)
    doc = b.column(b.schema.get_field_index("doc_id")).fill_null(_FIRST).to_numpy(zero_copy_only=False)
    rid = b.column(b.schema.get_field_index("rid")).to_numpy(zero_copy_only=False)
    return np.repeat(doc, n), np.repeat(rid, n), line, sets, sizes.astype(np.int64), word


_COLUMNS = [c for c in _ENTRY.names if c not in ("doc", "rid")]


def _pack(e: np.ndarray) -> bytes:
    """Entries by column; each document's id and row stand once, in front."""
    rid, first, row = np.unique(e["rid"], return_index=True, return_inverse=True)
    parts = [np.array([len(rid), len(e)], np.int64), np.diff(rid, prepend=0), np.diff(e["doc"][first], prepend=0), row.astype(np.uint32), *(np.ascontiguousarray(e[c]) for c in _COLUMNS)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """Entries of several blobs, by column."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in _ENTRY.names}
    for blob in blobs:
        data, at = zstandard.ZstdDecompressor().decompress(blob), 16
        m, n = np.frombuffer(data, np.int64, 2).tolist()

        def take(dtype, count: int, data: bytes = data) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        rid, doc = np.cumsum(take(np.int64, m)), np.cumsum(take(np.int64, m))
        row = take(np.uint32, n)
        parts["rid"].append(rid[row])
        parts["doc"].append(doc[row])
        for c in _COLUMNS:
            parts[c].append(take(_ENTRY[c], n))
    return {c: np.concatenate(x) for c, x in parts.items()}


def indexed(lines: DataFrame, levels, shards: int, t: float, buckets=None, *, places: bool = True, marked=None, ahead: bool | None = None) -> DataFrame:
    """shard and packed entries: a row for each shard that a batch of documents has entries for.

    ``buckets``: packed flags of the word buckets to send, if not all; ``marked``: a table of marks of the entries to send. Without
    ``places`` doc and rid are 0, and line is the number of lines that the set has in the batch. ``ahead``: instead of
    sketches AHEAD words before each entry and wide parities of the distinct sets (True), or all words of these (False), packed.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(levels.value, np.uint8)
        for b in _sliced(batches):
            doc, rid, line, sets, sizes, word = _unpacked(b)
            order = np.lexsort((line, rid, doc))
            _, first, times = np.unique(sets[order], return_index=True, return_counts=True)
            pick = np.sort(order[first])  # the first line of each set in the batch
            if not places:
                doc, rid, line = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int32)
                line[order[first]] = times
            starts = np.cumsum(sizes) - sizes
            e = entries(doc[pick], rid[pick], line[pick], sets[pick], sizes[pick], word[ragged(starts[pick], sizes[pick])], table, t, None if buckets is None else np.unpackbits(np.frombuffer(buckets.value, np.uint8)).astype(bool))
            if marked is not None:
                e = e[_marked(_keys(e), marked.value)]
            if ahead is not None:
                e["sketch"] = e["sketch2"] = 0
            shard = (mix(e["word"].astype(np.uint64) << np.uint64(32) | e["cell"].astype(np.uint64)) >> np.uint64(16)) % np.uint64(shards)
            order = np.argsort(shard << np.uint64(32) | e["word"].astype(np.uint64))
            names, at = np.unique(shard[order], return_index=True)
            e, at = e[order], np.append(at, len(e))
            columns = [pa.array(names.astype(np.int64)), pa.array([_pack(e[at[i] : at[i + 1]]) for i in range(len(names))], pa.binary())]
            if ahead is not None:
                columns.append(pa.array([told(e[at[i] : at[i + 1]], sets, sizes, word, table, ahead) for i in range(len(names))], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "entries", "words"][: len(columns)])

    return lines.mapInArrow(work, "shard bigint, entries binary" + ", words binary" * (ahead is not None))


def _by_rarity(sizes: np.ndarray, word: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The words of each set in the order of ``entries``."""
    level = levels[word >> np.uint32(32 - BUCKET_BITS)].astype(np.uint64)
    return word[np.argsort(np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(40) | level << np.uint64(32) | word.astype(np.uint64))]


def wide(word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 * WIDE parities of each set, as ``sketches`` has 64. The first column has all columns in one; it tells the first one by the others."""
    if not len(sizes):
        return np.zeros((0, WIDE), np.uint64)
    h = mix(word.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    bit, cell = np.left_shift(np.uint64(1), h & np.uint64(63)), (h >> np.uint64(6)) % np.uint64(WIDE)
    starts = np.cumsum(sizes) - sizes
    return np.stack([np.bitwise_xor.reduceat(bit if k == 0 else np.where(cell == k, bit, np.uint64(0)), starts) for k in range(WIDE)], axis=1)


def told(e, sets: np.ndarray, sizes: np.ndarray, word: np.ndarray, levels: np.ndarray, ahead: bool) -> bytes:
    """Words by rarity of the distinct sets of the entries, in order of the sets; with ``ahead`` the parities of these, one column
    of those of up to LONG words, and of each entry AHEAD of the words before it, the least by a hash, or its own for want of more."""
    names, place = np.unique(e["set"], return_inverse=True)
    order = np.argsort(sets, kind="stable")
    pick = order[np.searchsorted(sets, names, sorter=order)]
    n = sizes[pick]
    some = _by_rarity(n, word[ragged((np.cumsum(sizes) - sizes)[pick], n)], levels)
    if not ahead:
        return zstandard.ZstdCompressor(level=3).compress(some.tobytes())
    parity = wide(some, n)
    at = e["at"].astype(np.int64)
    before, owner = some[ragged((np.cumsum(n) - n)[place], at)], np.repeat(np.arange(len(e)), at)
    shared = levels[before >> np.uint32(32 - BUCKET_BITS)] > 1
    before, owner = before[shared], owner[shared]
    order = np.argsort(owner.astype(np.uint64) << np.uint64(32) | mix(before.astype(np.uint64)) >> np.uint64(32))
    before, owner = before[order], owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    few = np.repeat(e["word"][:, None], AHEAD, axis=1)
    few[owner[rank < AHEAD], rank[rank < AHEAD]] = before[rank < AHEAD]
    return zstandard.ZstdCompressor(level=3).compress(parity[:, 0].tobytes() + parity[n > LONG, 1:].tobytes() + few.T.tobytes())


def heard(f: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a shard with their sketches, its distinct sets, ascending, and their sizes and words by rarity."""
    names, sizes, word = [], [], []
    for blob, w in zip(f["entries"], f["words"], strict=True):
        e = _unpack([blob])
        own, first = np.unique(e["set"], return_index=True)
        names.append(own)
        sizes.append(e["n"][first].astype(np.int64))
        word.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(w), np.uint32))
    names, sizes, word = (np.concatenate(x) for x in (names, sizes, word))
    starts = np.cumsum(sizes) - sizes
    names, first = np.unique(names, return_index=True)
    sizes, word = sizes[first], word[ragged(starts[first], sizes[first])]
    e = _unpack(list(f["entries"]))
    e["sketch"], e["sketch2"] = (x[np.searchsorted(names, e["set"])] for x in sketches(word, sizes))
    return e, names, sizes, word


def heard_ahead(f: pd.DataFrame) -> dict[str, np.ndarray]:
    """The entries of a shard with their sketches, wide parities and the words told of those before them."""
    wides, words = [], []
    for blob, w in zip(f["entries"], f["words"], strict=True):
        e, data = _unpack([blob]), zstandard.ZstdDecompressor().decompress(w)
        names, first, place = np.unique(e["set"], return_index=True, return_inverse=True)
        long, end = e["n"][first] > LONG, len(data) - 4 * AHEAD * len(place)
        own = np.frombuffer(data[:end], np.uint64)
        parity = np.zeros((len(names), WIDE), np.uint64)
        parity[:, 0] = own[: len(names)]
        parity[long, 1:] = own[len(names) :].reshape(-1, WIDE - 1)
        parity[long, 0] ^= np.bitwise_xor.reduce(parity[long, 1:], axis=1)
        wides.append(parity[place])
        words.append(np.frombuffer(data[end:], np.uint32).reshape(AHEAD, -1).T)
    e = _unpack(list(f["entries"])) | {"wide": np.concatenate(wides), "ahead": np.concatenate(words)}
    return e | {"sketch": np.bitwise_xor.reduce(e["wide"], axis=1)}


def _group(e) -> np.ndarray:
    return e["word"].astype(np.uint64) << np.uint64(32) | e["cell"].astype(np.uint64)


def _ordered(e) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The entries by group and place, of each set the first line over all batches, and their groups."""
    group = _group(e)
    order = np.lexsort((e["line"], e["rid"], e["doc"], group))
    _, first = np.unique((mix(group) ^ np.ascontiguousarray(e["set"]).view(np.uint64))[order], return_index=True)
    order = order[np.sort(first)]
    return {c: e[c][order] for c in (e.dtype.names if isinstance(e, np.ndarray) else e)}, group[order]


def _close(e: dict[str, np.ndarray], group: np.ndarray, t: float, asked: np.ndarray | None = None, chunk: int = 500_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Of entries ordered by group the places x < y in a group whose sizes, positions and parities allow the similarity, and how many parities differ.

    ``asked``: the sets whose pairs with earlier ones are wanted, if not all.
    """
    n_all = len(group)
    new = np.append(True, group[1:] != group[:-1])[:n_all]
    start = np.maximum.accumulate(np.where(new, np.arange(n_all), 0)) if n_all else np.zeros(0, np.int64)
    before = np.arange(n_all) - start
    if asked is not None:
        before = np.where(np.isin(e["set"], asked), before, 0)
    ends = np.cumsum(before)
    at = 0
    while at < n_all:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right")))
        some = np.arange(at, to)
        y = np.repeat(some, before[some])
        x = ragged(start[some], before[some])
        n, m = e["n"][x].astype(np.int64), e["n"][y].astype(np.int64)
        ok = np.minimum(n, m) >= t * np.maximum(n, m) - 1e-9
        x, y, n, m = x[ok], y[ok], n[ok], m[ok]
        need = least_overlap(n, m, t)
        ok = 1 + np.minimum(n - e["at"][x] - 1, m - e["at"][y] - 1) >= need
        x, y, n, m, need = x[ok], y[ok], n[ok], m[ok], need[ok]
        far = np.bitwise_count(e["sketch"][x] ^ e["sketch"][y]).astype(np.int64)
        other = np.where(np.minimum(n, m) > LONG, np.bitwise_count(e["sketch2"][x] ^ e["sketch2"][y]), 0)
        ok = np.maximum(far, other) <= n + m - 2 * need
        yield x[ok], y[ok], far[ok].astype(np.int32)
        at = to


def paired(e, t: float, near: int | None, asked: np.ndarray | None = None, chunk: int = 500_000) -> tuple[np.ndarray, ...]:
    """Earlier and later sets that may be similar, the first documents of both, how many parities differ, and whether the later one had more partners than ``near``.

    ``e``: columns of _ENTRY, as a dictionary or a structured array.
    """
    e, group = _ordered(e)
    xs, ys, links, owns, fars, more = [], [], [], [], [], []
    for x, y, far in _close(e, group, t, asked, chunk):
        if near is not None and len(x):
            order = np.lexsort((x, far, y))
            x, y, far = x[order], y[order], far[order]
            first = np.searchsorted(y, y)
            rank = np.arange(len(y)) - first
            over = np.searchsorted(y, y, side="right") - first > near
            x, y, far, over = x[rank < near], y[rank < near], far[rank < near], over[rank < near]
        else:
            over = np.zeros(len(x), bool)
        xs.append(e["set"][x])
        ys.append(e["set"][y])
        links.append(e["doc"][x])
        owns.append(e["doc"][y])
        fars.append(far)
        more.append(over)
    if not xs:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.int32), np.zeros(0, bool)
    return tuple(np.concatenate(z) for z in (xs, ys, links, owns, fars, more))


def candidates(index: DataFrame, t: float, near: int | None, asked=None) -> DataFrame:
    """Distinct pairs x (earlier), y (later) of set hashes, link and own: the first documents with x and y, more: whether a shard left partners of y out."""

    def work(f: pd.DataFrame) -> pd.DataFrame:
        e = _unpack(f["entries"].tolist())
        x, y, link, own, far, more = paired(e, t, near, None if asked is None else np.frombuffer(asked.value, np.int64))
        return pd.DataFrame({"x": x, "y": y, "link": link, "own": own, "far": far, "more": more}).groupby(["x", "y"], as_index=False).agg({"link": "min", "own": "min", "far": "min", "more": "max"})

    return index.groupBy("shard").applyInPandas(work, "x bigint, y bigint, link bigint, own bigint, far int, more boolean").groupBy("x", "y").agg(F.min("link").alias("link"), F.min("own").alias("own"), F.min("far").alias("far"), F.max("more").alias("more"))


def _compared(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches whose last two columns are words, and which rows have Jaccard similarity t or more."""
    for r in batches:
        left, right = (r.column(r.num_columns - k).fill_null(b"") for k in (2, 1))
        n, m = (np.fromiter((len(v) // 4 for v in c.to_pylist()), np.int64, r.num_rows) for c in (left, right))
        row = np.concatenate([np.repeat(np.arange(r.num_rows), n), np.repeat(np.arange(r.num_rows), m)])
        key = np.sort(row.astype(np.uint64) << np.uint64(32) | np.concatenate([_joined(left, np.uint32), _joined(right, np.uint32)]).astype(np.uint64))
        same = key[1:][key[1:] == key[:-1]] >> np.uint64(32)
        overlap = np.bincount(same.astype(np.int64), minlength=r.num_rows)
        yield r, pa.array(overlap >= t * (n + m - overlap) - 1e-9)


def _verified_few(lines: DataFrame, few: pd.DataFrame, t: float) -> DataFrame:
    """The pairs are sent to the lines, and the words of each set, from its first document, to the numbers of its pairs: one shuffle."""
    x, y, link, own = (few[c].to_numpy(np.int64) for c in ("x", "y", "link", "own"))
    every = np.concatenate([x, y])
    order = np.argsort(every, kind="stable")
    sent = lines.sparkSession.sparkContext.broadcast((every[order], order, np.concatenate([link, own])[order], x, y, link))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, place, first = sent.value[:3]
        n = len(wanted) // 2
        for b in _sliced(batches):
            doc, _, _, sets, sizes, word = _unpacked(b)
            order = np.lexsort((doc, sets))
            names, pick = np.unique(sets[order], return_index=True)
            pick = order[pick]
            low, high = np.searchsorted(wanted, names, "left"), np.searchsorted(wanted, names, "right")
            hit = high > low
            pick, low, count = pick[hit], low[hit], (high - low)[hit]
            starts = np.cumsum(sizes) - sizes
            words = pa.array([word[starts[i] : starts[i] + sizes[i]].tobytes() for i in pick], pa.binary())
            spot, line = ragged(low, count), np.repeat(np.arange(len(pick)), count)
            here = first[spot] == doc[pick][line]
            at, line = place[spot[here]], line[here]
            yield pa.RecordBatch.from_arrays([pa.array(at % max(n, 1)), pa.array(at >= n), words.take(pa.array(line))], names=["pair", "later", "words"])

    told = lines.mapInArrow(tell, "pair bigint, later boolean, words binary")
    both = told.groupBy("pair").agg(F.first(F.when(~F.col("later"), F.col("words")), ignorenulls=True).alias("a"), F.first(F.when(F.col("later"), F.col("words")), ignorenulls=True).alias("b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ok in _compared(batches, t):
            at = r.column(0).filter(ok).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in sent.value[3:]], names=["x", "y", "link"])

    return both.mapInArrow(work, "x bigint, y bigint, link bigint")


def _words_of(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """set and its words, of the sets asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, _, sets, sizes, word = _unpacked(b)
            names, pick = np.unique(sets, return_index=True)
            starts = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([word[starts[i] : starts[i] + sizes[i]].tobytes() for i in pick], pa.binary())], names=["set", "words"])

    return lines.mapInArrow(work, "set bigint, words binary").join(asked, "set", "left_semi").groupBy("set").agg(F.first("words").alias("words"))


def verified(lines: DataFrame, pairs: DataFrame, t: float, most: int = KNOWN_MOST) -> DataFrame:
    """The pairs x, y, link with Jaccard similarity t or more. Up to ``most`` pairs are sent to the lines; more are joined with words."""
    pairs = pairs.select("x", "y", "link", "own")
    if pairs.limit(most + 1).count() <= most:
        return _verified_few(lines, pairs.toPandas(), t)
    known = stored(_words_of(lines, pairs.select(F.col("x").alias("set")).union(pairs.select("y")).distinct()), "sets")
    both = pairs.join(known.select(F.col("set").alias("x"), F.col("words").alias("a")), "x").join(known.select(F.col("set").alias("y"), F.col("words").alias("b")), "y").select("x", "y", "link", "a", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ok in _compared(batches, t):
            yield pa.RecordBatch.from_arrays(r.columns[:3], names=["x", "y", "link"]).filter(ok)

    return both.mapInArrow(work, "x bigint, y bigint, link bigint")


def _prepared(lines: DataFrame) -> tuple:
    """Broadcast rarity of the word buckets, and the number of words."""
    total = lines.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    return lines.sparkSession.sparkContext.broadcast(rarity(lines).tobytes()), total // 4


def _shards(words: int, most: int = 3_000_000) -> int:
    return max(1, math.ceil(words / most))


def first_matches(lines: DataFrame, t: float, near: int) -> DataFrame:
    """x, y, link: for each set y that is similar to an earlier one at least one such pair."""
    spark = lines.sparkSession
    levels, words = _prepared(lines)
    shards = _shards(words)
    index = indexed(lines, levels, shards, t)
    rank = F.row_number().over(Window.partitionBy("y").orderBy("far", "x"))
    pairs = stored(candidates(index, t, near).withColumn("rank", rank), "candidates")
    good = stored(verified(lines, pairs.where(F.col("rank") <= TRIED), t), "similar")
    others = pairs.where(F.col("rank") > TRIED).join(good.select("y").distinct(), "y", "left_anti")
    good = good.union(stored(verified(lines, others, t), "similar"))
    is_good = good.select(F.col("y").alias("set")).distinct()
    open_sets = stored(pairs.where("more").select(F.col("y").alias("set")).distinct().join(is_good, "set", "left_anti"), "open")
    blocks = math.ceil(open_sets.count() / KNOWN_MOST)
    for block in range(blocks):  # lines with more partners than ``near`` and none of those similar: all partners
        some = open_sets.where(F.pmod(F.xxhash64("set"), F.lit(blocks)) == block)
        sets = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in some.collect()], np.int64)).tobytes())
        buckets = spark.sparkContext.broadcast(_buckets_of(lines, sets))
        again = stored(candidates(indexed(lines, levels, shards, t, buckets), t, None, sets), "candidates")
        good = good.union(stored(verified(lines, again, t), "similar"))
    return good


def _keys(e) -> np.ndarray:
    """A number for the set and word of each entry."""
    return (np.ascontiguousarray(e["set"]).view(np.uint64) ^ mix(e["word"].astype(np.uint64))).view(np.int64)


def _marks(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _marked(keys: np.ndarray, table: bytes) -> np.ndarray:
    at = _marks(keys, (len(table) * 8).bit_length() - 1)
    return (np.frombuffer(table, np.uint8)[at >> 3] >> (at & 7)) & 1 == 1


def marks(index: DataFrame, find: Callable[[pd.DataFrame], tuple[np.ndarray, ...]], tables: int, bits: int) -> list[bytes]:
    """Tables of 2^bits bits that mark the keys that ``find`` gives for each shard; shards send distinct marks in SLICES slices."""
    width = (1 << bits) // SLICES

    def work(f: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, keys in enumerate(find(f)):
            at = np.unique(_marks(keys, bits))
            edges = np.searchsorted(at, np.arange(SLICES + 1) * width)
            rows += [(kind, k, zstandard.ZstdCompressor(level=1).compress(np.diff(at[edges[k] : edges[k + 1]], prepend=k * width).astype("<u4").tobytes())) for k in range(SLICES) if edges[k + 1] > edges[k]]
        return pd.DataFrame(rows, columns=["kind", "slice", "marks"])

    def add(f: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(width, bool)
        for x in f["marks"]:
            flags[np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u4"), dtype=np.int64)] = True
        return pd.DataFrame({"kind": f["kind"].iloc[:1], "slice": f["slice"].iloc[:1], "marks": [zstandard.ZstdCompressor(level=1).compress(np.packbits(flags, bitorder="little").tobytes())]})

    shape = "kind int, slice int, marks binary"
    out = np.zeros((tables, SLICES, width // 8), np.uint8)
    for r in index.groupBy("shard").applyInPandas(work, shape).groupBy("kind", "slice").applyInPandas(add, shape).collect():
        out[r["kind"], r["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["marks"]), np.uint8)
    return [x.tobytes() for x in out]


def partnered(e, t: float) -> tuple[np.ndarray, ...]:
    """Sets that may have a similar one, sets that more lines have, and keys of entries that have a partner; line is a number of lines."""
    group = _group(e)
    order = np.lexsort((e["set"], group))
    sets, group = e["set"][order], group[order]
    same = (sets[1:] == sets[:-1]) & (group[1:] == group[:-1])
    again = np.concatenate([sets[1:][same], e["set"][e["line"] > 1]])
    order = order[np.append(True, ~same)[: len(order)]]
    e = {c: e[c][order] for c in _COLUMNS}
    hit = np.zeros(len(order), bool)
    for x, y, _ in _close(e, _group(e), t):
        hit[x] = hit[y] = True
    return e["set"][hit], again, _keys(e)[hit]


def only_marked(lines: DataFrame, table) -> DataFrame:
    """The columns that ``indexed`` reads, with the lines of marked sets alone, of each set the first in a batch; documents without one are left out."""
    names = ["doc_id", "rid", "line_no", "sets", "sizes", "words"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            doc, rid, line, sets, sizes, word = _unpacked(b)
            ids = b.column(b.schema.get_field_index("rid")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.fromiter((len(x) // 4 for x in b.column(b.schema.get_field_index("line_no")).to_pylist()), np.int64, b.num_rows))
            order = np.lexsort((line, rid, doc))
            pick = np.sort(order[np.unique(sets[order], return_index=True)[1]])
            pick = pick[_marked(sets[pick], table.value)]
            docs, first = np.unique(row[pick], return_index=True)
            edges = np.append(first, len(pick))
            starts = np.cumsum(sizes) - sizes
            word, ends = word[ragged(starts[pick], sizes[pick])], np.append(0, np.cumsum(sizes[pick]))[edges]

            def blobs(x: np.ndarray, bounds: np.ndarray) -> pa.Array:
                return pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(bounds) - 1)], pa.binary())

            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).take(pa.array(docs)), pa.array(ids[docs]), blobs(line[pick], edges), blobs(sets[pick], edges), blobs(sizes[pick].astype(np.int32), edges), blobs(word, ends)], names=names)

    return lines.select(*names).mapInArrow(work, "doc_id bigint, rid bigint, line_no binary, sets binary, sizes binary, words binary")


def _common(word: np.ndarray, at: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many words the n from each ``at`` share with the m from each ``other``, about VERIFIED words at once."""
    out, ends, i = np.zeros(len(at), np.int64), np.cumsum(n + m), 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + VERIFIED, side="right")))
        pair = np.arange(j - i, dtype=np.uint64) << np.uint64(32)
        key = np.concatenate([np.repeat(pair, n[i:j]), np.repeat(pair, m[i:j])])
        key |= np.concatenate([word[ragged(at[i:j], n[i:j])], word[ragged(other[i:j], m[i:j])]]).astype(np.uint64)
        key.sort()
        out[i:j] = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64), minlength=j - i)
        i = j
    return out


def _united(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each one's component, after x and y are linked."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _met_once(e: dict[str, np.ndarray], group: np.ndarray, levels: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, ...]]:
    """The places x < y of ``_close``; two sets of one block meet in other cells as well and count in one."""
    block, blocks = _dealt(e["set"], levels[e["word"] >> np.uint32(32 - BUCKET_BITS)])
    for x, y, _ in _close(e, group, t):
        ok = np.minimum(block[x], block[y]) * blocks[x] + np.maximum(block[x], block[y]) == e["cell"][x]
        yield x[ok], y[ok]


def rarest(e, levels: np.ndarray, t: float) -> np.ndarray:
    """Keys of the entries that have a partner by the wide parities and share none of the words ahead with it."""
    e, group = _ordered(e)
    own = np.zeros(len(group), bool)
    for x, y in _met_once(e, group, levels, t):
        n, m = e["n"][x].astype(np.int64), e["n"][y].astype(np.int64)
        ok = (np.minimum(n, m) <= LONG) | (np.bitwise_count(e["wide"][x] ^ e["wide"][y]).sum(axis=1, dtype=np.int64) <= n + m - 2 * least_overlap(n, m, t))
        x, y = x[ok], y[ok]
        ahead, others = e["ahead"][x], e["ahead"][y]
        shared = np.zeros(len(x), bool)
        for i in range(AHEAD):
            other = ahead[:, i] != e["word"][x]
            for j in range(AHEAD):
                shared |= other & (ahead[:, i] == others[:, j])
        own[x[~shared]] = own[y[~shared]] = True
    return _keys(e)[own]


def linked(e, names: np.ndarray, sizes: np.ndarray, word: np.ndarray, levels: np.ndarray, t: float) -> dict[str, np.ndarray]:
    """set, root, links and later of the sets in similar pairs whose rarest common word is in these entries.

    ``names``: all distinct sets of the entries, ascending, with their sizes and words by rarity. root is the least set of the component by these pairs.
    """
    e, group = _ordered(e)
    starts = np.cumsum(sizes) - sizes
    links, later, root = np.zeros(len(names), np.int64), np.zeros(len(names), bool), np.arange(len(names))
    row = np.searchsorted(names, e["set"])
    for x, y in _met_once(e, group, levels, t):
        first = _common(word, starts[row[x]], e["at"][x].astype(np.int64), starts[row[y]], e["at"][y].astype(np.int64)) == 0
        x, y = row[x[first]], row[y[first]]
        overlap = _common(word, starts[x], sizes[x], starts[y], sizes[y])
        ok = overlap >= t * (sizes[x] + sizes[y] - overlap) - 1e-9
        x, y = x[ok], y[ok]
        links += np.bincount(x, minlength=len(names)) + np.bincount(y, minlength=len(names))
        later[y] = True
        root = _united(root, x, y)
    some = np.flatnonzero(links)
    return {"set": names[some], "root": names[root[some]], "links": links[some], "later": later[some]}


def all_links(lines: DataFrame, t: float) -> tuple[DataFrame, object]:
    """set, root, links and later of ``linked``, over all shards, and a broadcast table that marks the linked and the repeated sets."""
    sc = lines.sparkSession.sparkContext
    levels, words = _prepared(lines)
    bits = max(16, min(MARK_BITS, words.bit_length() - 1))
    first = indexed(lines, levels, _shards(words), t, places=False)
    near, again, hit = marks(first, lambda f: partnered(_unpack(f["entries"].tolist()), t), 3, bits)
    wanted = sc.broadcast((np.frombuffer(near, np.uint8) | np.frombuffer(again, np.uint8)).tobytes())
    near, hit = sc.broadcast(near), sc.broadcast(hit)
    some = stored(only_marked(lines, near), "marked", compression="zstd")
    shards = _shards(some.agg(F.sum(F.octet_length("words"))).first()[0] or 0, 4_000_000)

    second = indexed(some, levels, shards, t, places=False, marked=hit, ahead=True)
    own = sc.broadcast(marks(second, lambda f: (rarest(heard_ahead(f), np.frombuffer(levels.value, np.uint8), t),), 1, bits)[0])

    def work(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(linked(*heard(f), np.frombuffer(levels.value, np.uint8), t))

    last = indexed(some, levels, shards, t, marked=own, ahead=False)
    return stored(last.groupBy("shard").applyInPandas(work, "set bigint, root bigint, links bigint, later boolean"), "links"), wanted


def _by_set(lines: DataFrame, table=None) -> tuple[DataFrame, DataFrame]:
    """All lines with words, or those of marked sets, by set, and for each set its first place and number of lines."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            line, sets = (_joined(b.column(k), x) for k, x in ((2, np.int32), (3, np.int64)))
            n = np.fromiter((len(x) // 4 for x in b.column(2).to_pylist()), np.int64, b.num_rows)
            doc, rid = b.column(0).fill_null(_FIRST).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            ok = _marked(sets, table.value)
            yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (sets, np.repeat(doc, n), np.repeat(rid, n), line)], names=["set", "doc", "rid", "line"])

    shape = "set bigint, doc bigint, rid bigint, line int"
    spots = lines.mapInArrow(_spots, shape) if table is None else stored(lines.select("doc_id", "rid", "line_no", "sets").mapInArrow(marked, shape), "spots")
    return spots, spots.groupBy("set").agg(F.min(F.struct("doc", "rid", "line")).alias("first"), F.count("*").alias("n"))


def removed_lines(lines: DataFrame, *, similarity: float = SIMILARITY, near: int = NEAR) -> DataFrame:
    """rid, removed (line numbers) and links (a doc_id with an earlier similar line for each) of documents that lose lines."""
    good = first_matches(lines, similarity, near)
    spots, by_set = _by_set(lines)
    firsts = by_set.join(good.groupBy(F.col("y").alias("set")).agg(F.min("link").alias("link")), "set", "left").where((F.col("n") > 1) | F.col("link").isNotNull())
    firsts = stored(firsts.select("set", "first", "link"), "firsts")
    gone = spots.join(firsts, "set").where(F.col("link").isNotNull() | (F.struct("doc", "rid", "line") != F.col("first")))
    gone = gone.select("rid", "line", F.coalesce("link", "first.doc").alias("link"))
    return gone.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("line", "link"))).alias("g")).select("rid", F.col("g.line").alias("removed"), F.col("g.link").alias("links"))


def line_join(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document: doc_id, rid, n_lines, n_links, removed and classes.

    n_links sums over its lines the sets of other words that each is similar to; removed has the numbers of lines that an earlier
    line matches; classes has (line, class) of each line that is linked or repeated, class being the doc_id of the first line of its class.
    """
    small_batches(docs.sparkSession)
    lines = stored(line_sets(docs), "lines", compression="zstd")
    links, wanted = all_links(lines, similarity)
    each = stored(links.groupBy("set").agg(F.sum("links").alias("links"), F.max("later").alias("later"), F.array_sort(F.collect_set("root")).alias("roots")), "linked")
    joints = each.where(F.size("roots") > 1).select("set", F.explode("roots").alias("root"))  # a set with one root goes where that goes
    roots = components(joints, "set", "root").withColumnRenamed("root", "least")
    each = each.select("set", "links", "later", F.col("roots")[0].alias("node")).join(roots, "node", "left").select("set", "links", "later", F.coalesce("least", "node").alias("root"))
    spots, by_set = _by_set(lines, wanted)
    known = by_set.join(each, "set", "left").where((F.col("n") > 1) | F.col("links").isNotNull())
    known = stored(known.select("set", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("later", F.lit(False)).alias("later"), F.coalesce("root", "set").alias("root")), "sets")
    lead = stored(known.groupBy("root").agg(F.min("first").alias("lead")), "leads")  # a table of its own, so that the join may split a large class
    known = known.join(lead, "root").select("set", "first", "links", "later", F.col("lead.doc").alias("class"))
    met = spots.join(known, "set").select("rid", F.struct("line", "class", "links", (F.col("later") | (F.struct("doc", "rid", "line") != F.col("first"))).alias("gone")).alias("g"))
    per_doc = met.groupBy("rid").agg(F.sort_array(F.collect_list("g")).alias("g"))
    none = F.col("g").isNull()
    out = lines.select("doc_id", "rid", "n_lines").join(per_doc, "rid", "left")
    return out.select(
        "doc_id",
        "rid",
        "n_lines",
        F.when(none, F.lit(0).cast("long")).otherwise(F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["links"])).alias("n_links"),
        F.when(none, F.array().cast("array<int>")).otherwise(F.transform(F.filter("g", lambda x: x["gone"]), lambda x: x["line"])).alias("removed"),
        F.when(none, F.array().cast("array<struct<line:int,class:bigint>>")).otherwise(F.transform("g", lambda x: F.struct(x["line"].alias("line"), F.nullif(x["class"], F.lit(_FIRST)).alias("class")))).alias("classes"),
    )


def _buckets_of(lines: DataFrame, sets) -> bytes:
    """Packed flags of the word buckets that the sets have; each task sends its distinct bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BUCKET_BITS, bool)
        for b in batches:
            _, _, _, own, sizes, word = _unpacked(b)
            flags[word[np.repeat(np.isin(own, np.frombuffer(sets.value, np.int64)), sizes)] >> np.uint32(32 - BUCKET_BITS)] = True
        at = np.flatnonzero(np.packbits(flags))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.packbits(flags)[at].astype(np.int32), pa.int32())], names=["at", "bits"])

    got = lines.mapInArrow(work, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros((1 << BUCKET_BITS) // 8, np.uint8)
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.tobytes()


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, rid, line, sets, _, _ = _unpacked(b)
        yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array(doc), pa.array(rid), pa.array(line)], names=["set", "doc", "rid", "line"])


def line_links(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, rid, text_hash, n_lines, removed and links."""
    small_batches(docs.sparkSession)
    lines = stored(line_sets(docs), "lines", compression="zstd")
    gone = removed_lines(lines, **options)
    none = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    return lines.select("doc_id", "rid", "text_hash", "n_lines").join(gone, "rid", "left").select("doc_id", "rid", "text_hash", "n_lines", F.coalesce("removed", none[0]).alias("removed"), F.coalesce("links", none[1]).alias("links"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated lines cut out of ``text``; rows that keep no line with words are dropped if they lost any.

    Rows are told apart by doc_id and text; of equal ones the first stays. n_chars, if there, follows the text.
    """
    found = stored(line_links(docs, **options), "links")
    gone, doc, hash_, other, new = free_names(docs, "_removed", "_doc", "_hash", "_other", "_new")
    first = found.groupBy("doc_id", "text_hash").agg(F.min_by("removed", "rid").alias(gone))
    rows = docs.withColumn(hash_, F.xxhash64(F.coalesce("text", F.lit(""))))
    once = rows.dropDuplicates(["doc_id", hash_])
    met = once.join(first.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(other), gone), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(hash_) == F.col(other)))
    kept = F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(gone, s["i"])), lambda s: s["x"])
    text = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = met.withColumn(new, text).where((F.size(gone) == 0) | F.col(new).rlike(r"[^ \t-\r]"))
    out = out.withColumn("text", F.col(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    classes = F.array_join(F.transform("classes", lambda x: F.concat_ws(":", x["line"], x["class"])), ",")
    return out.select("doc_id", "n_lines", "n_links", F.array_join("removed", ",").alias("removed"), classes.alias("classes"))


OP6_SQL = r"""
WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS pos, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, pos, unnest(range(0, len(ls))) AS line, unnest(ls) AS t FROM p),
y AS MATERIALIZED (SELECT doc_id, pos, CAST(line AS INTEGER) AS line, list_sort(list_distinct(list_filter(string_split_regex(t, '[ \t-\r]+'), lambda w: w <> ''))) AS s FROM x),
z AS MATERIALIZED (SELECT s, arg_min(doc_id, pos * 1000000 + line) AS doc, min(pos * 1000000 + line) AS first, count(*) AS times FROM y WHERE len(s) > 0 GROUP BY s),
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY first) AS n, s, len(s) AS c, doc, first, times FROM z),
u AS (SELECT n, c, unnest(s) AS w FROM n),
f AS (SELECT w, count(*) AS df FROM u GROUP BY w),
q AS MATERIALIZED (SELECT n, w FROM (SELECT u.n, u.w, u.c, row_number() OVER (PARTITION BY u.n ORDER BY df, u.w) AS i FROM u JOIN f ON f.w = u.w) WHERE i <= c - ceil(0.8 * c) + 1),
cand AS (SELECT DISTINCT a.n AS a, b.n AS b FROM q a JOIN q b ON a.w = b.w AND a.n < b.n),
e AS MATERIALIZED (SELECT cand.a, cand.b FROM cand JOIN n x ON x.n = cand.a JOIN n y ON y.n = cand.b WHERE least(x.c, y.c) >= 0.8 * greatest(x.c, y.c) AND len(list_intersect(x.s, y.s)) >= 0.8 * (x.c + y.c - len(list_intersect(x.s, y.s)))),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
d AS (SELECT a AS n, count(*) AS links, min(b) AS least FROM l GROUP BY a),
r AS (SELECT DISTINCT a AS n, a AS m FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.n),
k AS (SELECT n, min(m) AS k FROM r GROUP BY n),
i AS (SELECT n.n, n.s, n.first, n.times, coalesce(d.links, 0) AS links, coalesce(d.least < n.n, FALSE) AS later, coalesce(k.k, n.n) AS k FROM n LEFT JOIN d ON d.n = n.n LEFT JOIN k ON k.n = n.n WHERE times > 1 OR d.links IS NOT NULL),
g AS (SELECT y.pos, y.line, i.links, later OR y.pos * 1000000 + y.line > i.first AS gone, lead.doc AS class FROM y JOIN i ON i.s = y.s JOIN n lead ON lead.n = i.k),
h AS (SELECT pos, CAST(sum(links) AS BIGINT) AS n_links, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (gone) AS removed, string_agg(line || ':' || class, ',' ORDER BY line) AS classes FROM g GROUP BY pos)
SELECT p.doc_id, CAST(len(ls) AS INTEGER) AS n_lines, coalesce(n_links, 0) AS n_links, coalesce(removed, '') AS removed, coalesce(classes, '') AS classes FROM p LEFT JOIN h ON h.pos = p.pos
"""
