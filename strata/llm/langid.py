"""Language identification: averaged hashed subword embeddings with a linear softmax.

Features of a text are the runs of 1 to 4 code points inside its lower-cased words (a word's edges
count as a blank), hashed into a fixed table of embedding rows. A text's vector is the average of its rows; a linear
layer and a softmax give class probabilities. Both are trained here by stochastic gradient descent in
numpy on a bounded sample of labelled texts. A temperature and a rejection threshold are fitted on a
part of the sample that training does not see.

Nulls and texts without a letter: language ``und``, score 0. Repeated rows are each predicted; ties
between classes go to the first label in order. Empty tables give empty results. If no labelled row can
be learned from, every row is ``und``. Other columns go through, but for those named as the results, which are replaced.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import fold, small_batches, spread, widened
from strata.llm.text import as_array, pieces

UND = "und"
_BITS = 16
_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def features(texts: list[str], longest: int = 4, bits: int = _BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed subwords of all texts, where each text's start, and how many letters each text has."""
    is_letter = letters()
    low = [f" {t.lower()} " for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = is_letter[np.minimum(points, 0x10FFFF)]
    chars = np.where(ok, points, np.uint32(32)).astype(np.uint64)
    owner = np.repeat(np.arange(len(low)), size)
    n_letters = np.bincount(owner, weights=ok, minlength=len(low)).astype(np.int64)
    codes, owners = [], []
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, longest + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + (chars[n - 1 :] + np.uint64(7919 * n))
        good = ok[:m].copy() if n == 1 else np.ones(m, bool)
        for k in range(1, n - 1):
            good &= ok[k : k + m]
        if n == 2:
            good = ok[:m] | ok[1 : 1 + m]
        elif n > 2:
            good &= owner[:m] == owner[n - 1 :]
        at = np.flatnonzero(good)
        x = h[at] * np.uint64(0x9E3779B97F4A7C15)
        codes.append((x >> np.uint64(64 - bits)).astype(np.int32))
        owners.append(owner[at].astype(np.int32))
    return np.concatenate(codes), np.concatenate(owners), n_letters


_BLANK = re.compile(r"\s")


def sliced(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of about ``most`` characters: pieces of texts, cut at blanks, and the index of each one's text. A longer word stays whole."""
    held, of, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            cut = _BLANK.search(t, at + most) if len(t) - at > most else None
            to = cut.start() if cut else len(t)
            held.append(t[at:to] if at or cut else t)
            of.append(i)
            size += to - at
            if size >= most:
                yield held, of
                held, of, size = [], [], 0
            if not cut:
                break
            at = to
    if held:
        yield held, of


@dataclass
class LanguageModel:
    """Embedding rows, linear layer and calibration."""

    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The linear layer is applied to the table once, then averaged: the same by linearity. Long texts are read in slices between words."""
        table = self.embeddings @ self.weights.T if table is None else table
        count, n_letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        sums = np.zeros((len(texts), len(self.labels)))
        for some, of in sliced(texts):
            codes, owners, letters = features(some)
            of = np.array(of)
            np.add.at(n_letters, of, letters)
            np.add.at(count, of, np.bincount(owners, minlength=len(some)))
            for c in range(len(self.labels)):
                np.add.at(sums[:, c], of, np.bincount(owners, weights=table[codes, c], minlength=len(some)))
        return sums / np.maximum(count, 1)[:, None] + self.bias, n_letters

    def predict(self, texts: list[str], table: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Labels, calibrated scores and whether each text is rejected."""
        if not texts:
            return [], np.zeros(0), np.zeros(0, bool)
        if not self.labels:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        z, n_letters = self.logits(texts, table)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(n_letters > 0, p.max(axis=1), 0.0)
        names = [self.labels[b] if n else UND for b, n in zip(best, n_letters)]
        return names, score, (n_letters == 0) | (score < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], *, dim: int = 16, epochs: int = 6, rate: float = 0.5, rejected: float = 0.001, seed: int = 5) -> LanguageModel:
    """Fit by SGD; a fifth of the texts calibrates temperature and threshold.

    The threshold is the score that all but a share ``rejected`` of rightly labelled calibration
    texts reach, and never over 0.4.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    model = LanguageModel(labels, rng.normal(0, 0.1, (1 << _BITS, dim)), np.zeros((len(labels), dim)), np.zeros(len(labels)))
    if not labels:
        return model
    y = np.array([labels.index(x) for x in langs])
    order = rng.permutation(len(texts))
    cut = len(texts) // 5
    held, used = order[:cut], order[cut:]
    each: list[np.ndarray] = []
    for at in range(0, len(texts), 100):  # a bounded part of the features is unsorted at a time
        codes, owners, _ = features(texts[at : at + 100])
        by_owner = np.argsort(owners, kind="stable")
        each += np.split(codes[by_owner], np.searchsorted(owners[by_owner], np.arange(1, len(texts[at : at + 100]))))
    steps, step = epochs * len(used), 0
    model.weights = rng.normal(0, 0.1, model.weights.shape)
    for _ in range(epochs):
        for i in rng.permutation(used):
            mine = each[i]
            lr = rate * (1 - step / max(steps, 1))
            step += 1
            if not len(mine):
                continue
            v = model.embeddings[mine].mean(axis=0)
            z = model.weights @ v + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ model.weights
            model.weights -= lr * np.outer(p, v)
            model.bias -= lr * p
            kinds, times = np.unique(mine, return_counts=True)
            model.embeddings[kinds] -= (lr * times / len(mine))[:, None] * back[None, :] * min(len(mine), 64)
    if cut >= 20:
        parts = [model.logits([texts[i] for i in held[at : at + 100]]) for at in range(0, cut, 100)]
        z, n_letters = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        z, t = z[n_letters > 0], y[held][n_letters > 0]
        grid = np.geomspace(0.25, 8, 21)
        loss = [-np.log(softmax(z / g)[np.arange(len(t)), t] + 1e-12).mean() for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == t]
        if len(right):
            model.threshold = float(min(0.4, np.quantile(right, rejected, method="lower")))
    return model


def rates(counts: list[tuple[int, int]], per_label: int, chars: int) -> list[float]:
    """Sampling rate of each label from its rows and characters: equal shares of ``chars``, what a label leaves going to the others."""
    full = [min(1.0, per_label / n) for n, _ in counts]
    out, left = list(full), float(chars)
    order = sorted(range(len(counts)), key=lambda i: full[i] * counts[i][1])
    for k, i in enumerate(order):
        want = full[i] * counts[i][1]
        given = min(want, left / (len(order) - k))
        left -= given
        out[i] = full[i] * given / want if want else full[i]
    return out


def fit(docs: DataFrame, learn: Column | None = None, *, per_label: int = 600, chars: int = 4_000_000) -> LanguageModel:
    """Train on at most about ``per_label`` texts of each label and ``chars`` characters of text.

    The sample takes rows by a hash of the id, at a rate from the count of each label, so it is the
    same on every run. ``chars`` bounds what reaches the driver: it is divided between the labels, so that only labels
    with more than their share are thinned.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect()
    rate = F.lit(0)
    for r, share in zip(counts, rates([(r["n"], r["c"]) for r in counts], per_label, chars)):
        rate = F.when(F.col("lang") == r["lang"], F.lit(int(share * (1 << 20)))).otherwise(rate)
    sample = rows.where(spread() < rate).select("text", "lang", "doc_id").toPandas() if counts else None
    if sample is None or not len(sample):
        return train([], [])
    sample = sample.sort_values(["doc_id", "lang", "text"])
    return train(sample["text"].tolist(), sample["lang"].tolist())


def apply(docs: DataFrame, model: LanguageModel, names: Sequence[str] = ("lang_pred", "lang_score", "rejected")) -> DataFrame:
    """All columns of docs with lang_pred, lang_score and rejected, under ``names``; columns of these names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    extra = list(names)
    keep = [c for c in docs.columns if c not in extra]
    schema = widened(docs.select(*keep), "`{}` string, `{}` double, `{}` boolean".format(*extra))
    small = LanguageModel(model.labels, model.embeddings.astype(np.float32), model.weights.astype(np.float32), model.bias, model.temperature, model.threshold)
    sent = spark.sparkContext.broadcast(pickle.dumps(small))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: LanguageModel = pickle.loads(sent.value)
        table = own.embeddings @ own.weights.T
        for b in pieces(batches, limit=1 << 19):
            found, score, rejected = own.predict(as_array(b.column(b.schema.get_field_index("text"))).to_pylist(), table)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*b.schema.names, *extra])

    return docs.select(*keep).mapInArrow(work, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, fold() != 2)
    out = apply(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
