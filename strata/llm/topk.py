"""Exact top-k by inner product: vectors by descending length, rotated partial sums, residual bounds.

Components become integers; scores are exact integer inner products. Rows are dealt to ranges of falling length, and packed into
blocks sorted by it. Vectors of one dimension are rotated by their right singular vectors, from their second-moment matrix
(one fixed-size sum), so the first coordinates carry most of the length. Each query has a k-th best score so far,
first from a bounded set of the longest vectors:

* a query is sent only to ranges whose longest vector can reach that score, |q| |x| (Cauchy-Schwarz);
* there vectors are passed in chunks of falling length, and the query stops for good once the bound is under its k-th score;
* in a chunk, a partial product over the leading rotated coordinates plus the product of the residual
  lengths bounds the score; only survivors get exact integer products.

Queries and blocks meet by an equi-join on the range; per pair of blocks only k rows a query that can still win are passed on.

Vectors that are null, empty of components, or hold components that are null or not finite (also after scaling) take no part, nor do null vec_ids.
A score needs vectors of one length, so the candidates of a query are the rows of its length, whatever lengths there are. Rows are
told apart by themselves: a query's own row is left out and no other, and repeated rows are candidates and queries each. Large components
are multiplied as Python integers where 64 bits may not do; scores beyond 64 bits are ranked by up to 38 digits (larger ones
as equal) and written as the nearest bigint. Empty tables give no rows. Equal scores go to the smaller vec_id. Other columns are left out.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.shared import small_batches, stored

BLOCK = 8192
QUERY_BLOCK = 2048
#: At most what Spark's WindowGroupLimit takes (1000), so that each task sends no more.
SEEDS = 1000
SEED_BYTES = 4 << 20
CHUNK = 512
#: Dimensions, the most common ones, that get a rotation and seeds; the others only miss that pruning.
TURNED = 8
_BLOCKS = "dim int, part int, top double, ids binary, rids binary, vs binary"
_RESULT = "query_id bigint, query bigint, vec_id bigint, score decimal(38,0)"
_LEAST = np.iinfo(np.int64).min
_WIDE = 10**38 - 1


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, x (scaled, not yet floored), dim, and norm (about the length) of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double") * F.lit(float(scale)))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))
    return rows.select("vec_id", "x", F.size("x").alias("dim"), norm.alias("norm"))


def _matrix(column: pd.Series) -> np.ndarray:
    """Floored vectors: 64-bit integers, or Python integers where one does not fit."""
    x = np.floor(np.stack(column.to_numpy()).astype(np.float64))
    return x.astype(np.int64) if np.abs(x).max(initial=0) < 1 << 62 else np.array([[int(v) for v in r] for r in x], object)


def moments(rows: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """For each dimension the sum of x xT, of vectors scaled to length 1 at most; each task sends one matrix a dimension."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {d: np.zeros((d, d)) for d in dims}
        for f in frames:
            for d, g in f.groupby("dim"):
                if d in total:
                    m = np.stack(g["x"].to_numpy()) / 1e150 if g["norm"].max() > 1e150 else np.stack(g["x"].to_numpy())
                    total[d] += m.T @ m
        for d, m in total.items():
            yield pd.DataFrame({"dim": d, "at": np.arange(d * d), "m": m.ravel()})

    got = rows.select("dim", "x", "norm").mapInPandas(work, "dim int, at int, m double").groupBy("dim", "at").agg(F.sum("m").alias("m")).orderBy("dim", "at").toPandas()
    return {int(d): g["m"].to_numpy().reshape(d, d) for d, g in got.groupby("dim")}


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows of one dimension, in the rows' order; top is the largest length in a block."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()

        def out(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for dim, g in f.groupby("dim"):
                for at in range(0, len(g), size):
                    h = g.iloc[at : at + size]
                    yield pd.DataFrame({"dim": [dim], "part": part, "top": h["norm"].max() + math.sqrt(dim), "ids": [h["vec_id"].to_numpy(np.int64).tobytes()], "rids": [h["rid"].to_numpy(np.int64).tobytes()], "vs": [np.stack(h["x"].to_numpy()).astype(np.float64).tobytes()]})

        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= size:
                whole = pd.concat(held)
                cut = len(whole) // size * size
                yield from out(whole.iloc[:cut])
                held = [whole.iloc[cut:]]
        if held:
            yield from out(pd.concat(held))

    return rows.select("vec_id", "rid", "x", "dim", "norm").mapInPandas(work, _BLOCKS)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray | None, k: int, floors: np.ndarray | None = None, lead: int = 16, order_ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, candidate index, score) of all that may be among the k best, and the number of exact products.

    ``q_ids`` and ``ids`` tell rows apart, ``order_ids`` settles ties; ``floors`` are scores that the k-th best reaches. ``x`` should be
    sorted by about descending length.
    """
    slack = 1e-6
    order_ids = ids if order_ids is None else order_ids
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    q_len, x_len = np.linalg.norm(qf, axis=1), np.linalg.norm(xf, axis=1)
    large = not q_len.max(initial=0) * x_len.max(initial=0) * q.shape[1] < 1 << 62
    if large:  # no bounds, exact products
        q, x = q.astype(object), x.astype(object)
        floors = None
    least = -(1 << 600) if large else _LEAST
    turn = np.eye(q.shape[1]) if rotation is None else rotation
    if not large:
        qr, xr = qf @ turn, xf @ turn
        q_rest, x_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(xr[:, lead:], axis=1)
        reach = np.maximum.accumulate(x_len[::-1])[::-1]
    best = np.full((len(q), k), least, object if large else np.int64)  # k best scores so far, ascending
    floors = best[:, 0] if floors is None else floors
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    exact = 0
    for at in range(0, len(x), CHUNK):
        to = min(at + CHUNK, len(x))
        if large:
            a, b = (z.ravel() for z in np.meshgrid(np.arange(len(q)), np.arange(at, to), indexing="ij"))
        else:
            floor = np.maximum(best[:, 0], floors).astype(np.float64)
            live = np.flatnonzero(q_len * reach[at] * (1 + slack) + slack >= floor)
            if not len(live):
                break
            bound = qr[live, :lead] @ xr[at:to, :lead].T + np.outer(q_rest[live], x_rest[at:to])
            bound += slack * (1 + np.outer(q_len[live], x_len[at:to]))
            a, b = np.nonzero(bound >= floor[live][:, None])
            a, b = live[a], b + at
        other = q_ids[a] != ids[b]
        a, b = a[other], b[other]
        if not len(a):
            continue
        exact += len(a)
        score = np.empty(len(a), best.dtype)
        for s in range(0, len(a), 1 << 16):
            score[s : s + (1 << 16)] = (q[a[s : s + (1 << 16)]] * x[b[s : s + (1 << 16)]]).sum(axis=1)
        found.append((a, b, score))
        order = np.lexsort((-score, a)) if not large else np.array(sorted(range(len(a)), key=lambda i: (a[i], -score[i])))
        a, score = a[order], score[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        top = rank < k
        new = np.full((len(q), k), least, best.dtype)
        new[a[top], rank[top]] = score[top]
        best = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, -k:]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, exact
    a, b, score = (np.concatenate(z) for z in zip(*found))
    good = score >= np.maximum(best[:, 0], floors)[a]
    a, b, score = a[good], b[good], score[good]
    order = np.lexsort((order_ids[b], -score, a)) if not large else np.array(sorted(range(len(a)), key=lambda i: (a[i], -score[i], order_ids[b[i]])), np.int64)
    a, b, score = a[order], b[order], score[order]
    top = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[top], b[top], score[top], exact


def _floors(rids: np.ndarray, q: np.ndarray, s_rids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query against the seeds: a lower bound of the final one."""
    if len(s) <= k or not np.linalg.norm(q.astype(np.float64), axis=1).max(initial=0) * np.linalg.norm(s.astype(np.float64), axis=1).max() * q.shape[1] < 1 << 62:
        return np.full(len(q), _LEAST)
    score = q @ s.T
    score[rids[:, None] == s_rids[None, :]] = _LEAST
    return np.partition(score, score.shape[1] - k, axis=1)[:, -k]


def _vectors(data: bytes, dim: int) -> np.ndarray:
    return _matrix(pd.Series(list(np.frombuffer(data, np.float64).reshape(-1, dim))))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """The k highest scores of each query row: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stored(usable(vectors, scale).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(TURNED).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    turns = {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in moments(rows, [*sizes]).items()}
    most = F.greatest(F.lit(1), F.least(F.lit(SEEDS), F.lit(SEED_BYTES) / (8 * F.col("dim"))))
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("norm"), "rid"))
    longest = rows.where(F.col("dim").isin([*sizes])).withColumn("place", place).where(F.col("place") <= SEEDS).where(F.col("place") <= most).toPandas()
    seeds = {int(d): (g["rid"].to_numpy(np.int64), _matrix(g["x"])) for d, g in longest.groupby("dim")}
    parts = max(1, math.ceil(sum(sizes.values()) / BLOCK))
    ranges = rows.repartitionByRange(parts, "dim", F.desc("norm"), "rid").sortWithinPartitions("dim", F.desc("norm"), "rid")
    blocks = stored(pack(ranges, BLOCK), "blocks")
    tops = {(r["dim"], r["part"]): r["top"] for r in blocks.groupBy("dim", "part").agg(F.max("top").alias("top")).collect()}  # as many as tasks
    sent = spark.sparkContext.broadcast(pickle.dumps((turns, seeds, tops)))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, seeds, tops = pickle.loads(sent.value)
        for f in frames:
            for r in f.itertuples(index=False):
                q_ids, rids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.rids, np.int64)
                x = np.frombuffer(r.vs, np.float64).reshape(-1, r.dim)
                q = _vectors(r.vs, r.dim)
                floors = _floors(rids, q, *seeds[r.dim], k) if r.dim in seeds else np.full(len(q), _LEAST)
                length = np.linalg.norm(q.astype(np.float64), axis=1)
                for (dim, part), top in tops.items():
                    if dim == r.dim:
                        need = ~(length * top * (1 + 1e-6) + 1e-6 < floors.astype(np.float64))
                        if need.any():
                            yield pd.DataFrame({"dim": [dim], "part": part, "q_ids": [q_ids[need].tobytes()], "q_rids": [rids[need].tobytes()], "q_vs": [np.ascontiguousarray(x[need]).tobytes()], "q_floors": [floors[need].astype(np.int64).tobytes()]})

    asked = pack(rows.where(queries), QUERY_BLOCK).mapInPandas(ask, "dim int, part int, q_ids binary, q_rids binary, q_vs binary, q_floors binary")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = pickle.loads(sent.value)[0]
        for f in frames:
            for r in f.itertuples(index=False):
                q_ids, rids, ids = (np.frombuffer(z, np.int64) for z in (r.q_ids, r.q_rids, r.ids))
                lead = max(1, min(r.dim - 1, r.dim // 2))
                a, b, score, _ = search_block(rids, _vectors(r.q_vs, r.dim), np.frombuffer(r.rids, np.int64), _vectors(r.vs, r.dim), turns.get(r.dim), k, np.frombuffer(r.q_floors, np.int64), lead, ids)
                yield pd.DataFrame({"query_id": q_ids[a], "query": rids[a], "vec_id": ids[b], "score": [*map(_decimal, score.tolist())]})

    won = blocks.join(asked, ["dim", "part"]).mapInPandas(work, _RESULT)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    low, high = (F.lit(str(v)).cast("decimal(38,0)") for v in (-(1 << 63), (1 << 63) - 1))
    score = F.least(F.greatest("score", low), high).cast("bigint")
    return won.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _decimal(score: int) -> Decimal:
    """A score as a decimal of 38 digits; larger ones are cut to that."""
    return Decimal(max(-_WIDE, min(_WIDE, score)))


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
