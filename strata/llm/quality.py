"""Quality classification by nearest-neighbour voting over latent-semantic vectors.

Terms of a text say how it is written, in any language: the shapes of its words (runs of capitals,
small letters, digits and marks), pairs of shapes that follow on, and words that repeat the one before, hashed
into a fixed number of columns. Logarithmic counts times inverse document frequency are projected by a truncated
SVD, fitted by subspace iteration on a bounded sample, and scaled to length 1. The sample's vectors and labels are
broadcast; each block of documents meets all of them in one exact matrix product of cosines, and
the ``neighbours`` nearest vote with their similarity as weight.

The score is the weighted share of votes for label 1. Null or empty texts, and texts with no similarity to any
labelled one, get the sample's share of label 1. Cosines are compared in steps of 2^-16; ties among neighbours go to the earlier of the sample, sorted by doc_id. Labels that
are null are left out; several labels of a doc_id count by their mean (0.5 and more is 1). Repeated rows are each scored. Without any label
all scores are 0.5. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import fold, small_batches, spread, widened
from strata.llm.text import as_array, pieces, words

COLUMNS = 4096
DIMENSIONS = 48
NEIGHBOURS = 15
LABELLED = 3000
CHARS = 12_000_000
_BLOCK = 500

_CLASS = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """Capitals as A, small and other letters as a, digits as 9; runs as one, longer runs of marks doubled."""
    return _RUNS.sub(lambda m: m[1] if m[1] in b"Aa9" else m[1] * 2, word.translate(_CLASS))[:24]


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed terms, a row for each text."""
    w = words(texts)
    n = w.n_texts
    if not len(w.codes):
        return np.zeros((n, COLUMNS), np.float32)
    kinds: dict[bytes, int] = {}
    of_word = np.fromiter((kinds.setdefault(shape(x), len(kinds)) for x in w.distinct.to_pylist()), np.int64, len(w.distinct))
    code = np.fromiter((zlib.crc32(k) for k in kinds), np.uint64, len(kinds))[of_word][w.codes]
    owner = w.owners()
    next_ = owner[1:] == owner[:-1]
    pairs = (code[:-1] * np.uint64(0x9E3779B1) + code[1:] * np.uint64(0x85EBCA77))[next_]
    again = (w.codes[1:] == w.codes[:-1]) & next_
    column = np.concatenate([code % np.uint64(1024), np.uint64(1024) + (pairs >> np.uint64(7)) % np.uint64(COLUMNS - 1025), np.full(int(again.sum()), COLUMNS - 1, np.uint64)]).astype(np.int64)
    row = np.concatenate([owner, owner[1:][next_], owner[1:][again]])
    return np.bincount(row * COLUMNS + column, minlength=n * COLUMNS).reshape(n, COLUMNS).astype(np.float32)


def scaled_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def embed(self, texts: pa.Array) -> np.ndarray:
        return scaled_rows((np.log1p(term_counts(texts)) * self.idf) @ self.axes)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(self.labels) or not len(texts):
            return np.full(len(texts), self.prior)
        cosine = self.embed(texts) @ self.vectors.T
        n, k = len(self.labels), min(self.neighbours, len(self.labels))
        # unique whole numbers: the cosine in steps of 2^-16, then the place in the sample, so that ties do not depend on the block
        rank = np.rint(cosine * (1 << 16)).astype(np.int64) * n + np.arange(n - 1, -1, -1)
        near = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-9), self.prior).clip(0, 1)


def train(texts: list[str], labels: list[int], seed: int = 3) -> QualityModel:
    """idf, axes and vectors of the labelled sample."""
    y = np.asarray(labels, np.float64)
    if not len(y):
        return QualityModel(np.ones(COLUMNS, np.float32), np.zeros((COLUMNS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    counts = np.concatenate([np.log1p(term_counts(pa.array(texts[at : at + _BLOCK], pa.string()))) for at in range(0, len(texts), _BLOCK)])
    idf = np.log((1 + len(y)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    counts *= idf
    d = min(DIMENSIONS, len(y))
    basis = np.random.default_rng(seed).normal(size=(COLUMNS, d + 8)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(counts.T @ (counts @ basis))
    _, _, turn = np.linalg.svd(counts @ basis, full_matrices=False)
    axes = (basis @ turn.T)[:, :d].astype(np.float32)
    return QualityModel(idf, axes, scaled_rows(counts @ axes).astype(np.float32), y, float(y.mean()))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, *, most: int = LABELLED, chars: int = CHARS) -> QualityModel:
    """Train on at most about ``most`` labelled rows and ``chars`` characters, taken by a hash of the id."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    n = known.count()
    if not n:
        return train([], [])
    picked = known.where(spread() < int(min(1.0, most / n) * (1 << 20)))  # about ``most`` rows
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > chars:
        rows = rows.where(spread(seed=12) < int(chars / size * (1 << 20)))
    sample = rows.toPandas().sort_values(["doc_id", "text"])
    return train(sample["text"].tolist(), sample["quality"].tolist())


def apply(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All columns of docs with ``score``."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[c for c in docs.columns if c != "score"])
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: QualityModel = pickle.loads(sent.value)
        for whole in pieces(batches, limit=4 << 20):
            for at in range(0, whole.num_rows, _BLOCK):
                b = whole.slice(at, _BLOCK)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.score(as_array(b.column(b.schema.get_field_index("text")))), pa.float64())], names=[*b.schema.names, "score"])

    return rows.mapInArrow(work, widened(rows, "score double"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold() != 2)
    return apply(docs, model).select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
