"""Licence scan by patience alignment of texts with notice templates.

Words are lower-cased runs between blanks and ASCII punctuation. Every template has cues, its words least common over all
templates, which occur in it once more at least than words may be missing at ``coverage``, so that a covered notice keeps one;
around each cue of a document lies a window as wide as the template on either side, and if the template is not found whole there, one as wide as the longest place that ``density`` allows. Template and window are aligned: words unique to both are anchors, the longest increasing
subsequence of anchors is kept, and the gaps between anchors are aligned the same way; a gap without unique words
falls back to a longest common subsequence, bounded by the window. Coverage is the share of the template's words
that are matched. A template is found if coverage reaches ``coverage`` and the matched words make up at least
``density`` of the span they lie in. Windows overlap whatever precedes or follows a cue, so no place is left out.

All places of all licences are kept until overlaps are settled: where places overlap, the one with most matched words stays, then the
best covered; within it other places of its own licence stay too. Of those that remain the best coverage of a licence is taken,
then the longest template, then the earliest place. Null and empty texts have no licence. Repeated rows each get their rows. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.decontaminate import ENDS
from strata.llm.license_texts import NOTICES
from strata.llm.shared import small_batches
from strata.llm.text import as_array, pieces, words

COVERAGE = 0.85
DENSITY = 0.6
RESULT = "doc_id bigint, license string, first_word int, last_word int, matched int, coverage double"


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of short lists."""
    if not a or not b:
        return []
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a[x] == 1}
        anchors = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place]
        if not anchors:
            shared = in_a.keys() & in_b.keys()
            ia, ib = [i for i in range(a0, a1) if a[i] in shared], [j for j in range(b0, b1) if b[j] in shared]
            out += [(ia[i], ib[j]) for i, j in _common([a[i] for i in ia], [b[j] for j in ib])]
            continue
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if k > i + 1 and m > j + 1]
    return sorted(out)


def least_matched(n: int, coverage: float) -> int:
    """The least number of n words with a share of ``coverage``, compared as the scan compares it."""
    return next(m for m in range(max(0, math.floor(coverage * n) - 1), n + 2) if m >= coverage * n)


class Templates:
    """Templates as word hashes, by cue."""

    def __init__(self, notices: dict[str, list[str]], coverage: float = COVERAGE):
        names = [(k, t) for k, ts in notices.items() for t in ts]
        w = words(pa.array([t for _, t in names], pa.string()), ENDS, lower=True)
        h = w.hashes()
        self.items = [(name, h[w.codes[w.starts[i] : w.starts[i + 1]]].tolist()) for i, (name, _) in enumerate(names)]
        common = Counter(x for _, t in self.items for x in set(t))
        self.cues: dict[int, list[int]] = {}
        for k, (_, t) in enumerate(self.items):
            known = sorted(set(t), key=lambda x: (t.count(x) * common[x], common[x], t.index(x)))
            spare = len(t) - least_matched(len(t), coverage)
            for cue in known:
                self.cues.setdefault(cue, []).append(k)
                spare -= t.count(cue)  # all of them may be changed
                if spare < 0:
                    break
        self.words = [Counter(t) for _, t in self.items]
        self.vocabulary = np.sort(np.array(list(self.cues), np.uint64))

    def _place(self, doc: list[int], k: int, p: int, reach: int, coverage: float, density: float) -> tuple[int, int, int] | None:
        """First and last word and matched words of template k around the cue at p, if it is covered there."""
        t, own = self.items[k][1], self.words[k]
        low, high = max(0, p - reach), min(len(doc), p + reach + 1)
        spare = len(t) - least_matched(len(t), coverage)
        near = doc[low:high]
        if len(own) - len(own.keys() & set(near)) > spare:
            return None
        here = Counter(x for x in near if x in own)
        if sum(n - min(n, here[x]) for x, n in own.items()) > spare:
            return None
        pairs = align(t, near)
        if len(pairs) < coverage * len(t):
            return None
        first, last = low + pairs[0][1], low + pairs[-1][1]
        return (first, last, len(pairs)) if len(pairs) >= density * (last - first + 1) else None

    def scan(self, doc: list[int], at: list[int], coverage: float, density: float) -> list[tuple[str, int, int, int, float]]:
        """Licences of a document with cues at the places ``at``."""
        places: dict[tuple[str, int, int, int], int] = {}
        for p in at:
            for k in self.cues[doc[p]]:
                name, t = self.items[k]
                for reach in (len(t), math.ceil(len(t) / density)):  # a place may be as long as its density allows
                    place = self._place(doc, k, p, reach, coverage, density)
                    if place is not None:
                        first, last, matched = place
                        places[name, len(t), first, last] = max(matched, places.get((name, len(t), first, last), 0))
                        if matched == len(t):
                            break
        starts: list[int] = []
        taken: list[tuple[int, str]] = []  # last word and licence of places that don't overlap, by first word
        order = sorted(((name, n, first, last, m) for (name, n, first, last), m in places.items()), key=lambda x: (-x[4], -x[4] / x[1], x[0], x[2], x[3]))
        best: dict[str, tuple] = {}
        for name, _, first, last, _ in order:
            i = bisect_right(starts, last)
            if not i or taken[i - 1][0] < first:
                starts.insert(i, first)
                taken.insert(i, (last, name))
        for name, n, first, last, m in order:
            i = bisect_right(starts, first) - 1
            if i >= 0 and taken[i][0] >= last and taken[i][1] == name:
                best[name] = max(best.get(name, (0,)), (m / n, n, -first, last, m))
        return sorted((name, -f[2], f[3], f[4], f[0]) for name, f in best.items())


def scan(docs: DataFrame, notices: dict[str, list[str]] | None = None, *, coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """A row of RESULT for each licence of each document; words count from 0."""
    notices = notices or NOTICES
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(notices, coverage)
        for b in pieces(batches):
            w = words(as_array(b.column(1)), ENDS, lower=True)
            h = w.hashes()
            cue = np.isin(h, own.vocabulary)[w.codes]
            hits = np.flatnonzero(cue)
            doc = np.searchsorted(w.starts, hits, side="right") - 1
            ids, out = b.column(0).to_pylist(), []
            for d, first, last in zip(*_runs(doc)):
                start = int(w.starts[d])
                text = h[w.codes[start : w.starts[d + 1]]].tolist()
                out += [(ids[d], *found) for found in own.scan(text, (hits[first:last] - start).tolist(), coverage, density)]
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["doc_id", "license", "first_word", "last_word", "matched", "coverage"])

    return rows.mapInArrow(work, RESULT)


def _runs(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Runs of equal values: value, begin, end."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[at].tolist(), at.tolist(), np.append(at[1:], len(x)).tolist() if len(x) else []


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
