"""Near-duplicates and line dedup against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import components as C
from strata.llm import dartminhash as D
from strata.llm import linededup as L
from strata.llm import shared
from strata.llm.components import components


def runs(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [runs(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def mutated(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


def test_classes_equal_brute_force(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows += [(100 + i, " ".join(mutated(rng, base, rng.randrange(0, 5)))) for i in range(60)]  # a chain of near copies
    rows += [(200 + i, " ".join(f"v{rng.randrange(500)}" for _ in range(30)) + " " + " ".join(base[:40])) for i in range(20)]  # a shared passage
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (512, 5):
        got = D.classes(docs, block=block).select("doc_id", "class_id").collect()
        assert sorted(map(tuple, got), key=repr) == brute_classes(rows)
    assert D.classes(no_docs).count() == 0
    kept = D.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in brute_classes(rows)} - {None}) + 2  # the text of no id, and two texts of doc_id 11


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    wa, wb = rng.integers(0, 4, 400).astype(float), rng.integers(0, 4, 400).astype(float)
    wa[:200] = wb[:200]
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    sig = [D.darts(ids[w > 0], w[w > 0], np.array([0, (w > 0).sum()]), 1024)[0] for w in (wa, wb)]
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 1024)
    tiny = D.darts(ids[:3], np.ones(3), np.array([0, 1, 3, 3]), 64)
    assert (tiny[0] != 0).all() and (tiny[2] == 0).all()


def test_elements_count_runs():
    r, w, s = D.elements(pa.array(["a b c d e a b c d e", "a b", ""]), 5, "count")
    assert s.tolist() == [0, 5, 6, 6] and sorted(w[:5].tolist()) == [1, 1, 1, 1, 2]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(0, i) for i in range(250, 300)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def brute_lines(rows, t=0.8):
    """Removed lines of rows in order of doc_id (null first)."""
    seen, index, out = [], {}, []
    for d, text in rows:
        gone = []
        for n, line in enumerate((text or "").split("\n")):
            s = frozenset(line.split())
            if not s:
                continue
            c = Counter(j for w in s for j in index.get(w, ()))
            if any(v >= t * (len(s) + len(seen[j]) - v) - 1e-9 for j, v in c.items()):
                gone.append(n)
            for w in s:
                index.setdefault(w, []).append(len(seen))
            seen.append(s)
        out.append((d, gone))
    return out


def line_rows():
    rng = random.Random(6)
    base = [f"w{rng.randrange(60)}" for _ in range(40)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if kind < 0.3:
                lines.append(" ".join(mutated(rng, base, rng.randrange(0, 8))))
            elif kind < 0.5:
                lines.append(" ".join(rng.choice(["the", "of", "and", "to", "in"]) for _ in range(rng.randrange(1, 7))))
            elif kind < 0.6:
                lines.append("")
            else:
                lines.append(" ".join(f"u{rng.randrange(3000)}" for _ in range(rng.randrange(1, 30))))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("near", [12, 1])
def test_removed_lines_equal_brute_force(spark, monkeypatch, near):
    rows = line_rows()
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    got = L.line_links(spark.createDataFrame(shuffled, "doc_id bigint, text string").repartition(3), near=near).collect()
    assert sorted((r["doc_id"], list(r["removed"])) for r in got) == brute_lines(rows)
    monkeypatch.setattr(L.verified, "__defaults__", (0,))  # pairs joined with words
    again = L.line_links(spark.createDataFrame(shuffled, "doc_id bigint, text string"), near=near).collect()
    assert sorted((r["doc_id"], list(r["removed"])) for r in again) == brute_lines(rows)
    assert all(len(r["links"]) == len(r["removed"]) and all(x <= r["doc_id"] for x in r["links"]) for r in got)


def brute_join(rows, t=0.8):
    """doc_id, n_lines, n_links, removed and (line, class) of rows in order of doc_id."""
    places, first = [], {}
    for d, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            s = frozenset(line.split())
            if s:
                first.setdefault(s, (d, n))
                places.append((d, n, s))
    sets = list(first)  # by first place
    links, parent = Counter(), {s: s for s in sets}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    later = set()
    for j, b in enumerate(sets):
        for a in sets[:j]:
            if len(a & b) >= t * len(a | b) - 1e-9:
                links.update((a, b))
                later.add(b)
                a, c = sorted((find(a), find(b)), key=sets.index)
                parent[c] = a
    times = Counter(s for _, _, s in places)
    out = []
    for d, text in rows:
        mine = [(n, s) for e, n, s in places if e == d]
        out.append((d, len((text or "").split("\n")), sum(links[s] for _, s in mine), [n for n, s in mine if s in later or first[s] != (d, n)], [(n, first[find(s)][0]) for n, s in mine if times[s] > 1 or links[s]]))
    return out


@pytest.mark.parametrize("hot,most", [(4096, 1_000_000), (4, 0)])
def test_line_join_equals_brute_force(spark, monkeypatch, no_docs, edge_docs, hot, most):
    monkeypatch.setattr(L, "HOT", hot)
    monkeypatch.setattr(L.verified, "__defaults__", (most,))
    rows = line_rows()
    rng = random.Random(9)
    base = [f"k{i}" for i in range(30)]
    rows += [(100 + i, " ".join(mutated(rng, base, rng.randrange(0, 4)))) for i in range(40)]  # chains: similar to a neighbour only
    rows += [(200, None), (201, "")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = L.line_join(spark.createDataFrame(shuffled, "doc_id bigint, text string").repartition(3)).collect()
    mine = sorted((r["doc_id"], r["n_lines"], r["n_links"], list(r["removed"]), [tuple(c) for c in r["classes"]]) for r in got)
    assert mine == brute_join(rows) and sum(r[2] for r in mine) > 200
    assert L.line_join(no_docs).count() == 0
    edge = L.line_join(edge_docs).collect()
    assert len(edge) == edge_docs.count() and all(r["n_links"] is not None for r in edge)


def test_pairs_of_near_copies_are_not_written_out(spark, monkeypatch):
    wrote = []

    def stored(df, name, **options):
        out = shared.stored(df, name, **options)
        wrote.append((name, out.count()))
        return out

    monkeypatch.setattr(L, "stored", stored)
    monkeypatch.setattr(C, "stored", stored)
    n = 150
    near = [" ".join(f"k{j}" if j != i % 40 else f"own{i}" for j in range(40)) for i in range(n)]  # any two are similar
    chain = [" ".join(f"c{j}" for j in range(i, i + 20)) for i in range(60)]  # similar to two before and two after only
    rows = [(i, text) for i, text in enumerate(near + chain + near[:5])]
    got = {r["doc_id"]: r for r in L.line_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    mine = [(r["doc_id"], r["n_lines"], r["n_links"], list(r["removed"]), [tuple(c) for c in r["classes"]]) for _, r in sorted(got.items())]
    assert mine == brute_join(rows)
    assert {got[i]["n_links"] for i in range(n)} == {n - 1} and {got[n + i]["classes"][0]["class"] for i in range(60)} == {n}
    assert max(count for _, count in wrote) < 4 * len(rows), wrote


def test_a_pair_counts_where_its_rarest_common_word_is():
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = {frozenset(mutated(rng, base[: rng.randrange(110, 151)], rng.randrange(0, 9))) for _ in range(60)} | {frozenset(base[i : i + 15]) for i in range(40)}
    word = {w: i * 2654435761 % 2**32 for i, w in enumerate(sorted(set().union(*texts)))}
    sets = sorted(texts, key=lambda s: sorted(s))
    words = [np.sort(np.array([word[w] for w in s], np.uint32)) for s in sets]
    sizes, flat, ids = np.array([len(w) for w in words]), np.concatenate(words), np.arange(len(sets))
    levels = L.scaled(np.bincount(flat >> np.uint32(32 - L.BUCKET_BITS), minlength=1 << L.BUCKET_BITS))
    e = L.entries(ids, ids, np.zeros(len(sets), np.int32), ids, sizes, flat, levels, 0.8)
    links, later = np.zeros(len(sets), int), np.zeros(len(sets), bool)
    for shard in range(5):
        mine = e[e["word"] % 5 == shard]
        marked = L.rarest(L.heard_ahead({"entries": [L._pack(mine)], "words": [L.told(mine, ids, sizes, flat, levels, True)]}), levels, 0.8)
        mine = mine[np.isin(L._keys(mine), marked)]
        got = L.linked(*L.heard({"entries": [L._pack(mine)], "words": [L.told(mine, ids, sizes, flat, levels, False)]}), levels, 0.8)
        links[got["set"]] += got["links"]
        later[got["set"]] |= got["later"]
    near = [[i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert links.tolist() == [sum(x) for x in near] and links.sum() > 100
    assert later.tolist() == [any(x[:i]) for i, x in enumerate(near)]


def test_hot_words_are_dealt_over_cells(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT", 4)
    rows = line_rows()
    levels = np.full(1 << L.BUCKET_BITS, 80, np.uint8)  # every word counts as hot
    sets = [frozenset(t.split()) for _, t in rows for t in t.split("\n") if t.split()]
    distinct = list(dict.fromkeys(sets))
    word = [np.sort(np.array([hash(w) & 0xFFFFFFFF for w in s], np.uint32)) for s in distinct]
    n = len(distinct)
    e = L.entries(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int32), np.arange(n), np.array([len(w) for w in word]), np.concatenate(word), levels, 0.8)
    x, y, *_ = L.paired(e, 0.8, None)
    found = set(zip(x.tolist(), y.tolist()))
    want = {(i, j) for j in range(n) for i in range(j) if len(distinct[i] & distinct[j]) >= 0.8 * len(distinct[i] | distinct[j])}
    assert want <= found and (e["cell"] > 0).any()


def test_line_dedup_edges(spark, edge_docs, no_docs):
    out = L.without_repeats(edge_docs)
    assert out.columns == edge_docs.columns
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (4, "") in got and (5, None) in got and (6, "  \n \t") in got  # lines without words stay
    assert sum(d == 3 for d, _ in got) == 0  # copies of 1 go
    assert L.without_repeats(no_docs).count() == 0 and L.line_links(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "a b\nc d e"), (1, "a b\nc d e"), (2, "c d e\nnew line here")], "doc_id bigint, text string")
    assert sorted(map(tuple, L.without_repeats(twice).collect())) == [(1, "a b\nc d e"), (2, "new line here")]
