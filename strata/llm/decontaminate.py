"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs between blanks and ASCII punctuation. Seeds are hashes of ``least`` words running on; a
document is compared with an item only if the item's positions under shared seeds reach the
threshold, which bounds what tiles can cover. For such a pair the longest common run of unmarked
words is marked again and again, found by running Karp-Rabin over both sides with a falling length,
until no run of ``least`` words is left. Coverage is the share of the item's words under tiles, so a
passage is caught in any order of its parts.

An item with fewer than ``least`` words has no tile: it matches if the document holds all its words running on; one without words never does. Null or empty texts have no words. Repeated rows are
each judged; items with equal texts all match. Empty tables: no item, no match. The benchmark is
broadcast in blocks of at most ``block_bytes`` of text, one pass over the documents for each block.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import small_batches, widened
from strata.llm.text import BLANKS, Words, as_array, pieces, shingle_hashes, words

#: Bytes that end a word: blanks and ASCII punctuation.
ENDS = BLANKS + bytes(b for b in range(33, 127) if not chr(b).isalnum())
LEAST = 4
COVERAGE = 0.5
_MOD = (1 << 61) - 1
_BASE = 1_000_003


def _windows(ids: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Rolling hash and start of each window of ``size`` unmarked words."""
    top = pow(_BASE, size - 1, _MOD)
    h, run = 0, 0
    for i, x in enumerate(ids):
        if marked[i]:
            h, run = 0, 0
            continue
        if run >= size:
            h = (h - (ids[i - size] + 1) * top) % _MOD
        h = (h * _BASE + x + 1) % _MOD
        run += 1
        if run >= size:
            yield h, i - size + 1


def greedy_tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length), longest first; ties to the earliest starts."""
    in_p, in_t = [False] * len(pattern), [False] * len(text)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(pattern), len(text)))
    while True:
        places = defaultdict(list)
        for h, i in _windows(pattern, in_p, size):
            places[h].append(i)
        heap: list[tuple[int, int, int]] = []
        for h, j in _windows(text, in_t, size) if places else ():
            for i in places.get(h, ()):
                if i and j and pattern[i - 1] == text[j - 1] and not in_p[i - 1] and not in_t[j - 1]:
                    continue  # part of a run that begins earlier
                n = 0
                while i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n] and not in_p[i + n] and not in_t[j + n]:
                    n += 1
                if n >= size:
                    heap.append((-n, i, j))
        heapify(heap)
        while heap:
            n, i, j = heappop(heap)
            free = [not in_p[i + x] and not in_t[j + x] for x in range(-n)]
            if all(free):
                in_p[i : i - n] = [True] * -n
                in_t[j : j - n] = [True] * -n
                tiles.append((i, j, -n))
                continue
            run = 0
            for x, ok in enumerate([*free, False]):  # what longer tiles have left of it
                if not ok and run >= size:
                    heappush(heap, (-run, i + x - run, j + x - run))
                run = run + 1 if ok else 0
        if size == least:
            return tiles
        size = max(least, size // 2)


class Items:
    """A block of the benchmark ready for search."""

    def __init__(self, item_ids: list[int], texts: list[str], least: int, coverage: float):
        w = words(pa.array(texts, pa.string()), ENDS, lower=True)
        self.ids, self.least, self.coverage = item_ids, least, coverage
        h = w.hashes()
        names = h[w.codes]
        self.words = [names[w.starts[i] : w.starts[i + 1]] for i in range(w.n_texts)]
        seeds, starts = shingle_hashes(w, least, h)
        owner = np.repeat(np.arange(w.n_texts), np.diff(starts))
        at = np.arange(len(seeds)) - starts[owner]
        ok = np.array([len(x) >= least for x in self.words], bool)[owner] if len(owner) else np.zeros(0, bool)
        order = np.argsort(seeds[ok], kind="stable")
        self.seeds, self.owner, self.at = seeds[ok][order], owner[ok][order], at[ok][order]
        #: Items too short for a tile, as one run each, by their number of words.
        self.short = {}
        for n in range(1, least):
            own = np.flatnonzero([len(x) == n for x in self.words])
            if len(own):
                one, first = shingle_hashes(w, n, h)
                order = np.argsort(one[first[own]], kind="stable")
                self.short[n] = one[first[own]][order], own[order]
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.seeds >> np.uint64(48)).astype(np.int64)] = True

    def search(self, w: Words) -> dict[int, list[tuple[int, float]]]:
        """For each text with matches: (item index, coverage)."""
        names = w.hashes()
        found = self._held(w, names)
        if not len(self.seeds):
            return found
        runs, starts = shingle_hashes(w, self.least, names)
        hit = np.flatnonzero(self.gate[(runs >> np.uint64(48)).astype(np.int64)])
        low = np.searchsorted(self.seeds, runs[hit])
        good = low < len(self.seeds)
        good[good] = self.seeds[low[good]] == runs[hit][good]
        hit = hit[good]
        if not len(hit):
            return found
        doc = np.searchsorted(starts, hit, side="right") - 1
        first = np.searchsorted(self.seeds, runs[hit], side="left")
        count = np.searchsorted(self.seeds, runs[hit], side="right") - first
        pair: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for d, p, f, n in zip(doc.tolist(), (hit - starts[doc]).tolist(), first.tolist(), count.tolist()):
            for s in range(f, f + n):
                pair[d, int(self.owner[s])].append((p, int(self.at[s])))
        for (d, item), seeds in pair.items():
            mine = self.words[item]
            under = np.zeros(len(mine) + 1, np.int64)
            at = np.unique([q for _, q in seeds])
            np.add.at(under, at, 1)
            np.add.at(under, np.minimum(at + self.least, len(mine)), -1)
            if (np.cumsum(under)[:-1] > 0).sum() < self.coverage * len(mine):
                continue
            share = self._tiled(mine, names[w.codes[w.starts[d] : w.starts[d + 1]]], sorted({p for p, _ in seeds}))
            if share >= self.coverage:
                found[d].append((item, share))
        return found

    def _held(self, w: Words, names: np.ndarray) -> dict[int, list[tuple[int, float]]]:
        """Short items that a text holds whole."""
        found: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for n, (items, own) in self.short.items():
            runs, starts = shingle_hashes(w, n, names)
            low, high = np.searchsorted(items, runs, "left"), np.searchsorted(items, runs, "right")
            hit = np.flatnonzero(high > low)
            doc = np.searchsorted(starts, hit, side="right") - 1
            for d, at in sorted({(d, at) for d, a, b in zip(doc.tolist(), low[hit].tolist(), high[hit].tolist()) for at in range(a, b)}):
                if w.starts[d + 1] - w.starts[d] >= n:
                    found[d].append((int(own[at]), 1.0))
        return found

    def _tiled(self, item: np.ndarray, doc: np.ndarray, at: list[int]) -> float:
        """Coverage by tiles; words of the document under no seed can be in no tile and end runs."""
        text: list[int] = []
        code: dict[int, int] = {}
        pattern = [code.setdefault(x, len(code)) for x in item.tolist()]
        end = -1
        for p in at:
            if p > end:
                text.append(-2 - p)  # a word that occurs nowhere else
                end = p
            for x in doc[end : p + self.least].tolist():
                text.append(code[x])
            end = max(end, p + self.least)
        return sum(n for _, _, n in greedy_tiles(pattern, text, self.least)) / len(pattern)


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_bytes: int = 8 << 20, names: Sequence[str] = ("items", "coverages")) -> DataFrame:
    """All columns of docs with ``items`` (ids of matched items, ascending) and ``coverages`` beside them, under ``names``; columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    extra = list(names)
    rows = docs.select(*[c for c in docs.columns if c not in extra])
    schema = widened(rows, "`{}` array<bigint>, `{}` array<double>".format(*extra))
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1

    for block in range(blocks):
        some = usable.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(pickle.dumps(Items([r[0] for r in some], [r[1] for r in some], least, coverage)))
        rows = rows.mapInArrow(_searching(sent, len(rows.columns) < len(schema.names), extra), schema)
    return rows


def _searching(sent, first: bool, extra: list[str]):
    """A pass over documents with one block of items; adds to what earlier passes found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Items = pickle.loads(sent.value)
        for b in pieces(batches, limit=1 << 20):
            texts = as_array(b.column(b.schema.get_field_index("text")))
            found = own.search(words(texts, ENDS, lower=True)) if len(own.ids) else {}
            hits = [[(own.ids[i], c) for i, c in found.get(d, ())] for d in range(b.num_rows)]
            if first:
                columns, names = b.columns, b.schema.names
            else:
                columns, names = b.columns[:-2], b.schema.names[:-2]
                hits = [[*h, *zip(i, c)] for h, i, c in zip(hits, b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            hits = [sorted(h) for h in hits]
            ids, shares = [[i for i, _ in h] for h in hits], [[c for _, c in h] for h in hits]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float64()))], names=[*names, *extra])

    return work


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", F.round(F.coalesce(F.array_max("coverages"), F.lit(0.0)), 6).alias("coverage"))
