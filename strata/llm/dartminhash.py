"""MinHash near-duplicate detection with DartMinHash signatures and banded joining.

A text is the weighted set of its runs of five words (weight 1 each, or the number of occurrences).
Over each element lies a plane, weight by rank, cut into unit cells; every cell holds a hashed Poisson
number of darts with a rank, a weight and one of k coordinates, the same for all texts. A dart counts
for a text if it falls under the element's weight, and the earliest dart per coordinate is the text's
signature: two texts share a coordinate with a chance of their weighted Jaccard similarity. Only about
k (ln k + 4) darts are looked at, however long the text; a text with an empty coordinate looks further up.

Signatures are cut into bands. Texts that share a band are candidates, and all candidate pairs are
settled by exact Jaccard over the hashed runs, without writing out all pairs of a band:

1. each text against the least text of each of its bands; accepted pairs make components;
2. bands that still hold several components: their texts meet in cells of at most two blocks of
   ``block`` texts, every pair of blocks of a band having a cell; texts of different components are
   compared exactly, and a pair is kept only where it joins two components.

So texts are one class exactly if a chain of accepted candidate pairs links them. At similarity 0.8, 32 bands of 4 miss
a pair with a chance of 5e-8. Equal texts are one node from the start, keyed by a 64-bit hash.

Null texts count as empty; all empty texts are one class of equal texts and have no runs. A text of
fewer than five words is one run. A null doc_id stays null, and takes no part in the least doc_id of a class. Repeated
rows each get a row; where different texts share a doc_id, classes are told apart by root. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.components import components
from strata.llm.shared import free_names, small_batches, stored
from strata.llm.text import as_array, mix, pieces, ragged, shingle_hashes, words

K = 128
ROWS = 4
WORDS = 5
SIMILARITY = 0.8
BLOCK = 512

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RANK_BITS = 18


def elements(texts: pa.Array, size: int, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of all texts, their weights, and where each text's runs start; sorted within a text."""
    runs, starts = shingle_hashes(words(texts), size)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(runs))).astype(np.float64) if weights == "count" else np.ones(len(at))
    return runs[at], weight, np.searchsorted(owner[at], np.arange(len(texts) + 1))


def darts(runs: np.ndarray, weight: np.ndarray, starts: np.ndarray, k: int, seed: int = 0, limit: int = 500_000) -> np.ndarray:
    """Signatures, a row for each text; texts without elements get zeros."""
    n = len(starts) - 1
    best = np.full((n, k), np.iinfo(np.uint64).max, np.uint64)
    total = np.add.reduceat(np.append(weight, 0.0), starts[:-1]) if n else np.zeros(0)
    total[np.diff(starts) == 0] = 0
    reach = np.where(total > 0, k * (math.log(k) + 4) / np.maximum(total, 1e-300), 0.0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        cost = (np.ceil(reach[todo]) * np.ceil(total[todo] + np.diff(starts)[todo])).astype(np.int64)
        group = np.cumsum(cost) // limit
        for g in np.unique(group):
            _throw(best, runs, weight, starts, todo[group == g], reach, k, seed)
        todo = todo[(best[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        reach[todo] *= 2
        best[todo] = np.iinfo(np.uint64).max
    best[total == 0] = 0
    return best.astype(np.uint32)


def _throw(best: np.ndarray, runs: np.ndarray, weight: np.ndarray, starts: np.ndarray, some: np.ndarray, reach: np.ndarray, k: int, seed: int) -> None:
    """All darts of the texts ``some`` up to their reach; the least rank wins each coordinate."""
    sizes = starts[some + 1] - starts[some]
    at, owner = ragged(starts[some], sizes), np.repeat(some, sizes)
    deep = np.ceil(weight[at]).astype(np.int64)  # cells along the weight axis
    cell_of = np.repeat(np.arange(len(at)), deep)
    level = ragged(np.zeros(len(at), np.int64), deep)
    high = np.ceil(reach[owner[cell_of]]).astype(np.int64)  # cells along the rank axis
    base = mix(runs[at[cell_of]] + level.astype(np.uint64) * _STEP + np.uint64(seed))
    cells = np.repeat(np.arange(len(cell_of)), high)
    row = ragged(np.zeros(len(cell_of), np.int64), high)
    h = mix(base[cells] + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    count = np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right")
    dart = np.repeat(np.arange(len(h)), count)
    h = mix(h[dart] + (ragged(np.zeros(len(count), np.int64), count) + 1).astype(np.uint64) * _STEP)
    rank = row[dart] + (h >> np.uint64(32)).astype(np.float64) / float(1 << 32)
    owner, level, w = owner[cell_of][cells][dart], level[cells][dart], weight[at][cell_of][cells][dart]
    keep = rank < reach[owner]
    whole = level + 1 <= w
    if not whole.all():
        keep &= whole | (level + (mix(h) >> np.uint64(32)).astype(np.float64) / float(1 << 32) < w)
    h, rank, owner = h[keep], rank[keep], owner[keep]
    place = owner * k + (h & np.uint64(0xFFFF)).astype(np.int64) % k
    key = (np.minimum(rank * (1 << _RANK_BITS), float((1 << 32) - 1)).astype(np.uint64) << np.uint64(32)) | (mix(h + _STEP) & np.uint64(0xFFFFFFFF))
    np.minimum.at(best.reshape(-1), place, key)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    n, k = signature.shape
    cut = signature[:, : k // rows * rows].reshape(n, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, k // rows + 1, dtype=np.uint64)), cut.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _STEP + cut[:, :, r])
    return key.view(np.int64)


def signed(docs: DataFrame, k: int, rows: int, size: int, weights: str) -> DataFrame:
    """node and key: a row for each band of each distinct text of a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=3 << 20):
            nodes, at = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
            runs, weight, starts = elements(as_array(b.column(1).take(pa.array(at))), size, weights)
            full = np.diff(starts) > 0
            keys = bands(darts(runs, weight, starts, k), rows)[full]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[full], keys.shape[1])), pa.array(keys.reshape(-1))], names=["node", "key"])

    return docs.select("node", "text").mapInArrow(work, "node bigint, key bigint")


def with_runs(docs: DataFrame, size: int) -> DataFrame:
    """node and its sorted distinct runs as bytes of 64-bit hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=3 << 20):
            nodes, at = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
            runs, _, starts = elements(as_array(b.column(1).take(pa.array(at))), size, "set")
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([runs[starts[i] : starts[i + 1]].tobytes() for i in range(len(nodes))], pa.binary())], names=["node", "runs"])

    return docs.select("node", "text").mapInArrow(work, "node bigint, runs binary").groupBy("node").agg(F.first("runs").alias("runs"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _accepted(pairs: DataFrame, runs: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose runs have Jaccard similarity ``least`` or more."""
    left = runs.select(F.col("node").alias("a"), F.col("runs").alias("ra"))
    right = runs.select(F.col("node").alias("b"), F.col("runs").alias("rb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = x.column(2).to_pylist(), x.column(3).to_pylist()
            ok = [min(len(p), len(q)) >= least * max(len(p), len(q)) - 1e-6 and jaccard(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= least for p, q in zip(a, b)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb").mapInArrow(work, "a bigint, b bigint")


def joined_in_cell(nodes: np.ndarray, roots: np.ndarray, runs: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs that link different components; every pair of texts of different components is settled.

    Texts outside the largest component look up all texts that share a run with them.
    """
    parent = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(r) for r in runs])
    flat, owner = np.concatenate(runs), np.repeat(np.arange(len(runs)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    names, counts = np.unique(roots, return_counts=True)
    found = []
    for i in np.flatnonzero(roots != names[counts.argmax()]):
        low, high = np.searchsorted(flat, runs[i], "left"), np.searchsorted(flat, runs[i], "right")
        both = np.bincount(owner[ragged(low, high - low)], minlength=len(runs))
        for j in np.flatnonzero(both >= least * (sizes + sizes[i] - both)):
            x, y = find(int(roots[i])), find(int(roots[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((int(nodes[i]), int(nodes[j])))
    return found


def _rest(members: DataFrame, labels: DataFrame, runs: DataFrame, least: float, block: int) -> DataFrame:
    """Pairs that join components which still meet in a band."""
    rows = members.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where((F.col("n") > 2) & (F.col("low") != F.col("high"))).select("key", F.ceil(F.col("n") / block).cast("int").alias("m"))
    cells = rows.join(mixed, "key").withColumn("c", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("key", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"), "node", "root")
    cells = cells.join(runs, "node")

    def work(f: pd.DataFrame) -> pd.DataFrame:
        if f["root"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        f = f.drop_duplicates("node")
        pairs = joined_in_cell(f["node"].to_numpy(), f["root"].to_numpy(), [np.frombuffer(r, np.uint64) for r in f["runs"]], least)
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return cells.groupBy("key", "x", "y").applyInPandas(work, "a bigint, b bigint")


def classes(docs: DataFrame, *, similarity: float = SIMILARITY, size: int = WORDS, k: int = K, rows: int = ROWS, weights: str = "set", block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, node (hash of the text), class_id (the least doc_id of its class), class_size and root (the least node)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    keyed = stored(signed(texts, k, rows, size, weights).distinct(), "bands")
    least_of = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where(F.col("n") > 1).select("key", "least")
    members = stored(keyed.join(least_of, "key"), "members")
    pairs = stored(members.where(F.col("node") != F.col("least")).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    asked = members.select("node").distinct()
    runs = stored(with_runs(texts.join(asked, "node", "left_semi"), size), "runs")
    first = stored(_accepted(pairs, runs, similarity), "accepted")
    labels = components(first, "a", "b")
    more = stored(_rest(members.select("key", "node"), labels, runs, similarity, block), "accepted")
    if more.limit(1).count():
        labels = components(first.union(more), "a", "b")
    by_root = texts.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    by_root = stored(by_root, "labelled")
    least_doc = by_root.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return by_root.join(least_doc, "root").select("doc_id", "class_id", "class_size", "node", "root")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that lead their class: the least doc_id (null last), then the least text hash; one row of equal ones."""
    found = stored(classes(docs, **options), "classes")
    doc, node, hash_ = free_names(docs, "_doc", "_node", "_hash")
    lead = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("lead")).select(F.col("lead.doc_id").alias(doc), F.col("lead.node").alias(node))
    rows = docs.withColumn(hash_, F.xxhash64(F.coalesce("text", F.lit(""))))
    picked = rows.join(lead, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(hash_) == F.col(node)), "left_semi")
    return picked.dropDuplicates(["doc_id", hash_]).select(*docs.columns)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size")


OP2_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY text) AS n, text, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS w FROM t),
s AS MATERIALIZED (SELECT DISTINCT n, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS r FROM w),
c AS (SELECT n, count(*) AS c FROM s GROUP BY n),
o AS (SELECT a.n AS a, b.n AS b, count(*) AS o FROM s a JOIN s b ON a.r = b.r AND a.n < b.n GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN c x ON x.n = a JOIN c y ON y.n = b WHERE o >= 0.8 * (x.c + y.c - o)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT n, n AS m FROM w UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.n),
k AS (SELECT n, min(m) AS k FROM r GROUP BY n),
d AS (SELECT doc_id, k FROM documents JOIN w ON w.text = coalesce(documents.text, '') JOIN k ON k.n = w.n)
SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS class_size FROM d
"""
