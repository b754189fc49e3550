"""Elias-Fano sequences and tries against plain lists; scores against a direct model."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from strata.llm import ngramlm as N
from strata.llm.eliasfano import EliasFano, TrieLevel


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (50, 60), (1000, 1 << 40), (300, 300), (70000, 1 << 20)])
def test_sequence(n, universe, tmp_path):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
    s = EliasFano.build(v, universe)
    assert (s.get(np.arange(n)) == v).all()
    s.save(Path(tmp_path), "s")
    s = EliasFano.load(Path(tmp_path), "s")
    x = rng.integers(0, universe, 200).astype(np.uint64)
    zero, end = np.zeros(200, np.int64), np.full(200, n)
    assert (s.successor(x, zero, end) == np.searchsorted(v, x)).all()
    if n > 10:
        first = rng.integers(0, n, 200)
        last = np.minimum(first + rng.integers(0, 9, 200), n)
        want = [next((i for i in range(a, b) if v[i] >= q), b) for a, b, q in zip(first, last, x)]
        assert s.successor(x, first, last).tolist() == want


def test_level(tmp_path):
    rng = random.Random(1)
    pairs = sorted({(rng.randrange(40), rng.randrange(1 << 32)) for _ in range(500)})
    p, i = (np.array(x) for x in zip(*pairs))
    values = np.array([rng.uniform(-3, 5) for _ in pairs])
    level = TrieLevel.build(p, i, 41, {"gain": values}).mapped(Path(tmp_path), "x")
    assert (level.find(p, i) == np.arange(len(p))).all()
    assert (level.find(p, (i + 1) & 0xFFFFFFFF)[[(a, (b + 1) & 0xFFFFFFFF) not in set(pairs) for a, b in pairs]] == -1).all()
    assert level.find(np.array([40]), np.array([5])).tolist() == [-1]
    assert np.abs(level.value("gain", np.arange(len(p))) - values).max() <= 8 / 255 / 2 + 1e-9


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\0"]


def conditional(rows, train):
    """The model in plain words: counts of single words, N, V and p(word, the two before it; None before a text's first)."""
    c1, c2, c3 = Counter(), Counter(), Counter()
    for (_, text), k in zip(rows, train):
        if k:
            t = tokens(text)
            q = ["\1", *t]
            c1.update(t)
            c2.update(zip(q, t))
            c3.update(zip(q, t, t[1:]))
    n, v = sum(c1.values()), len(c1)
    c1["\1"] = sum(train)
    often = lambda w: w in "\0\1" or c1[w] * N.FREQUENT >= n and c1[w] > 0

    def p(w, before, two):
        p1 = (c1[w] + 1) / (n + v + 1)
        out = (c2[before, w] + N.A * p1) / (c1[before] + N.A)
        if two is not None and often(before) and (seen := c2[two, before]):
            out = (c3[two, before, w] + N.B * out) / (seen + N.B)
        return out

    return c1, n, v, p


def direct(rows, train):
    c1, n, v, p = conditional(rows, train)
    out = []
    for _, text in rows:
        t = tokens(text)
        q = ["\1", *t]
        base = sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t)
        total = sum(math.log10(p(w, q[i], q[i - 1] if i else None)) for i, w in enumerate(t))
        out.append((len(t), sum(c1[w] > 0 for w in t), n, base, total))
    return out


def frame(spark, rows, train):
    return spark.createDataFrame([(d, t, k, 0.0) for (d, t), k in zip(rows, train)], "doc_id bigint, text string, learn boolean, score double")


@pytest.mark.parametrize("often,shard", [(1 << 16, 3_000_000), (20, 300)])
def test_scores_equal_a_direct_model(spark, monkeypatch, often, shard):
    monkeypatch.setattr(N, "FREQUENT", often)
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(150)]
    rows = [(i, " ".join(rng.choice(vocabulary).upper() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "É é  x"), (5, "twice"), (5, "twice"), (None, "no id")]
    train = [i % 3 > 0 for i in range(len(rows))]
    got = N.score(frame(spark, rows, train).repartition(1), __import__("pyspark.sql.functions", fromlist=["col"]).col("learn"), shard).collect()
    want = direct(rows, train)
    key = lambda x: (repr(x[0]), x[1], x[2], round(x[3], 4))
    mine = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["train_tokens"]) for r in got], key=key)
    theirs = sorted([(d, n, k, b, s, t) for (d, _), (n, k, t, b, s) in zip(rows, want)], key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a[:3] == b[:3] and a[5] == b[5] and abs(a[3] - b[3]) < 1e-6 and abs(a[4] - b[4]) <= 0.05 * b[1]


def test_empty_cases(spark, edge_docs, no_docs):
    from pyspark.sql import functions as F

    assert N.score(no_docs, F.lit(True)).count() == 0
    got = N.score(edge_docs, F.lit(False)).collect()
    assert len(got) == edge_docs.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-9 for r in got)


def test_distribution_is_proper():
    """Summed over all words seen, the end and one unknown word, the probabilities after any context are 1."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 9)))) for i in range(30)]
    c1, n, v, p = conditional(rows, [True] * 30)
    words = [w for w in c1 if w != "\1"]
    for before in [*words, "\1", "unseen"]:
        for two in [None, *words, "\1", "unseen"]:
            if before != "\0" and two != "\0":
                assert abs(sum(p(w, before, two) for w in [*words, "zzz"]) - 1) < 1e-9


@pytest.mark.parametrize("often,shard", [(1 << 16, 3_000_000), (20, 300), (3, 90)])
def test_rare_middle_words_are_contexts(spark, monkeypatch, often, shard):
    """With every context the scores are those of a model without a bound on the middle word, whatever is broadcast."""
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(150)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(vocabulary[:20]) for _ in range(9))) for i in range(9)] + [(60, None), (61, ""), (62, rows[1][1]), (63, rows[2][1])]
    train = [i % 3 > 0 for i in range(len(rows))]
    want = direct(rows, train)  # by the bound of a small table: every word seen is a context
    monkeypatch.setattr(N, "FREQUENT", often)
    got = N.score(frame(spark, rows, train).repartition(3), __import__("pyspark.sql.functions", fromlist=["col"]).col("learn"), shard, every_context=True).collect()
    mine = {r["doc_id"]: r for r in got}
    assert len(got) == len(mine) == len(rows)
    for (d, _), (n, known, _, base, total) in zip(rows, want):
        assert (mine[d]["n_tokens"], mine[d]["n_known"]) == (n, known)
        assert abs(mine[d]["base_score"] - base) < 1e-6 and abs(mine[d]["score"] - total) <= 0.05 * n


def test_counts_of_rare_contexts_are_exact(monkeypatch):
    """Third-order gains use c(v), from the shard, from the answers, or 1."""
    known = N.Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64), 4, 40, 12)
    v, w = (np.array([x | 1 << 63], np.uint64) for x in (77, 99))
    word, before = np.repeat(w, 3), np.repeat(N.short_codes(v), 3)
    two, train = np.full(3, 9, np.uint32), np.ones(3)
    for c in (1, 25):
        sent = (N.short_codes(v), np.array([c], np.uint64)) if c > 1 else (np.zeros(0, np.uint32), np.zeros(0, np.uint64))
        _, score, _ = N.shard_sums(word, before, two, train, known, None, sent)
        p1 = (3 + 1) / (40 + 12 + 1)
        p2 = (3 + N.A * p1) / (c + N.A)
        want = math.log10(p1) + math.log10(N.A / (3 + N.A)) + math.log10(1 + 3 / (N.A * p1)) + math.log10(N.B / (3 + N.B)) + math.log10(1 + 3 / (N.B * p2))
        assert abs(score - want).max() < 1e-4
