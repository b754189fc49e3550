"""Top-k, decontamination and licences against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import decontaminate, licenses, topk


def brute_top(rows, queries, k=5):
    """(query_id, rank, vec_id, score) in exact integers; rows are told apart by place."""
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(256 * x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v]))
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for p, (i, q) in enumerate(good):
        if queries(i):
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for r, (j, x) in enumerate(good) if r != p and len(x) == len(q))
            out += [(i, n, j, clamp(-s)) for n, (s, j) in enumerate(best[:k], 1)]
    return sorted(out)


def vectors_of(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3.0) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, rank int, score string, rid int, norm double").repartition(4)


@pytest.mark.parametrize("block", [8192, 40])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SEEDS", block // 4)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, rng.choice([0.05, 1, 3])) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, rows[i % 4][1]) for i in range(30)] + [(900, None), (901, [None] * 12), (902, [math.nan] * 12), (903, [math.inf] * 12), (904, []), (None, [1.0] * 12)]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (100, rows[100][1])]  # repeated query rows, and another with the same vec_id
    rows += [(1000 + i, [rng.gauss(0, 2) for _ in range(5)]) for i in range(60)] + [(2000, [3.0]), (2001, [1.0]), (2050, [1.0, 2.0])]  # other lengths, one alone
    got = sorted(map(tuple, topk.top_k(vectors_of(spark, rows), F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == brute_top(rows, lambda i: i % 50 == 0)
    assert topk.top_k(vectors_of(spark, rows).limit(0), F.lit(True)).count() == 0


def test_top_k_of_equal_lengths_and_ties(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(120)]
    assert sorted(map(tuple, topk.top_k(vectors_of(spark, rows, "float"), F.col("vec_id") % 50 == 0, 5).collect())) == brute_top(rows, lambda i: i % 50 == 0)
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 128)]


def test_top_k_of_large_components(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 0, 0, 3, 11, 30 * (i > 50)]) for _ in range(3)]) for i in range(60)] + [(60, [1e300, 0.0, 0.0]), (61, [2e8, 2e8, 2e8]), (62, [2e8, -2e8, 1.0])]
    got = sorted(map(tuple, topk.top_k(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, 5).collect()))
    want = brute_top(rows, lambda i: i % 10 == 0)
    assert [(q, r, s) for q, r, _, s in got] == [(q, r, s) for q, r, _, s in want]
    exact = {(q, r) for q, r, _, s in want if abs(s) < (1 << 63) - 1}
    assert len(exact) > 4 and [g for g in got if g[:2] in exact] == [w for w in want if w[:2] in exact]


def test_top_k_plan_has_no_cross_join(spark):
    rows = [(i, [float(i), 1.0]) for i in range(40)]
    plan = topk.top_k(vectors_of(spark, rows), F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bounds_save_products():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(4000, 32)) * np.linspace(3, 0.1, 32) * rng.gamma(1, 1, (4000, 1)) * 200).astype(np.int64)
    x = x[np.argsort(-(x * x).sum(axis=1), kind="stable")]
    _, v = np.linalg.eigh((x.T @ x).astype(float))
    ids = np.arange(len(x))
    a, b, s, exact = topk.search_block(ids[:20], x[:20], ids, x, v[:, ::-1].copy(), 5, topk._floors(ids[:20], x[:20], ids[:256], x[:256], 5), 8)
    assert exact < 0.2 * 20 * len(x)
    for q in range(20):
        want = sorted((-(x[q] @ x[j]), j) for j in range(len(x)) if j != q)[:5]
        assert [(-int(t), int(j)) for t, j in zip(s[a == q], b[a == q])] == [(int(t), j) for t, j in want]


def brute_tiles(p, t, least):
    mp, mt, out = [0] * len(p), [0] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sum(x[0] for x in out)
        mp[i : i + n], mt[j : j + n] = [1] * n, [1] * n
        out.append(best)


def test_tiles_equal_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        p = [rng.randrange(5) for _ in range(rng.randrange(0, 25))]
        t = [rng.randrange(5) for _ in range(rng.randrange(0, 30))]
        tiles = decontaminate.greedy_tiles(p, t, 3)
        assert all(p[i : i + n] == t[j : j + n] and n >= 3 for i, j, n in tiles)
        used = [k for i, _, n in tiles for k in range(i, i + n)]
        assert len(used) == len(set(used))
        assert [n for _, _, n in tiles] == sorted((n for _, _, n in tiles), reverse=True)
        assert sum(n for _, _, n in tiles) == brute_tiles(p, t, 3)


def test_periodic_texts_take_bounded_time():
    import time

    begin = time.process_time()
    tiles = decontaminate.greedy_tiles([0, 1] * 300, [0, 1] * 2000, 4)
    assert tiles == [(0, 0, 600)] and time.process_time() - begin < 10


def brute_matches(docs, items, least=4, coverage=0.5):
    cut = lambda t: [w for w in re.split(r"[\x09-\x0D\x20!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = {}
    for d, text in docs:
        t, hits = cut(text), []
        for i, item in items:
            p = cut(item)
            if i is None or not p:
                continue
            if len(p) < least:
                ok = any(t[j : j + len(p)] == p for j in range(len(t)))
            else:
                ok = brute_tiles(p, t, least) >= coverage * len(p)
            hits += [i] * ok
        out[d] = sorted(hits)
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["a", "b", "c", "Dd", "e"]) + str(rng.randrange(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 8, 15, 30])))) for i in range(25)] + [(90, ""), (91, None), (92, " ... ")]
    docs = []
    for d in range(80):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 20)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(items)[1] or ""
            p = p.split()
            k = rng.randrange(len(p) + 1)
            parts += [" ".join(p[k:] + p[: rng.randrange(k + 1)]), " ".join(word() for _ in range(3))]
        docs.append((d, ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, "x")]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r["doc_id"]: list(r["items"]) for r in got.collect()} == brute_matches(docs, items)


def test_decontamination(spark, edge_docs, no_docs):
    rng = random.Random(5)
    item = [f"q{rng.randrange(900)}" for _ in range(40)]
    other = [f"z{rng.randrange(900)}" for _ in range(25)]
    noise = lambda n: " ".join(f"n{rng.randrange(5000)}" for _ in range(n))
    moved = item[20:] + ["x"] + item[:20]
    docs = spark.createDataFrame([(1, noise(50) + " " + " ".join(item) + " " + noise(9)), (2, noise(30) + " " + ", ".join(moved).upper()), (3, noise(80)), (4, " ".join(item[:12])), (5, " ".join(other + item)), (6, None), (7, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, "two words"), (13, None), (None, "a b c d e f"), (14, " ".join(item))], "item_id bigint, text string")
    for block in (1 << 20, 50):
        got = {r["doc_id"]: list(r["items"]) for r in decontaminate.matches(docs, bench, block_bytes=block).collect()}
        assert got == {1: [10, 14], 2: [10, 14], 3: [], 4: [], 5: [10, 11, 14], 6: [], 7: []}
    assert decontaminate.matches(edge_docs, bench).count() == edge_docs.count()
    assert decontaminate.matches(no_docs, bench).count() == 0
    assert decontaminate.matches(edge_docs, bench.limit(0)).where(F.size("items") > 0).count() == 0


def test_alignment_pieces():
    assert licenses.increasing([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5] and licenses.increasing([]) == []
    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 15))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_license_scan(spark, edge_docs, no_docs):
    words = " ".join(f"w{i}" for i in range(300))
    mit = licenses.NOTICES["MIT"][2]
    changed = mit.replace("free of charge", "at no charge").upper().replace(" ", "\n", 40)
    docs = spark.createDataFrame(
        [(1, f"{words} Released under the MIT License. {words}"), (2, f"{words}\n{changed}\n{words}"), (3, "Licensed under CC BY-NC 4.0."), (4, words), (5, "the license of the river"), (6, f"{licenses.NOTICES['GPL-3.0'][0]}. {words} Licensed under the Apache License, Version 2.0"), (7, None)],
        "doc_id bigint, text string",
    )
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(docs).collect())
    assert got == [(1, "MIT"), (2, "MIT"), (3, "CC-BY-NC-4.0"), (6, "Apache-2.0"), (6, "GPL-3.0")]
    spot = licenses.scan(docs).where("doc_id = 1").first()
    assert (spot["first_word"], spot["last_word"], spot["coverage"]) == (300, 304, 1.0)
    assert licenses.scan(edge_docs).count() == 0 and licenses.scan(no_docs).count() == 0


@pytest.mark.parametrize("name", sorted(licenses.NOTICES))
def test_each_notice_is_found(spark, name):
    own = licenses.Templates(licenses.NOTICES)
    for i, (k, t) in enumerate(own.items):
        if k == name:
            found = own.scan(t, [p for p, x in enumerate(t) if x in own.cues], 0.85, 0.6)
            assert name in {f[0] for f in found}, i


@pytest.mark.parametrize("k", range(sum(map(len, licenses.NOTICES.values()))))
def test_notices_with_their_rarest_words_changed_are_found(k):
    """As many words as coverage allows are changed, single ones first; also where every changed word occurs once."""
    own = licenses.Templates(licenses.NOTICES)
    name, t = own.items[k]
    spare = len(t) - math.ceil(0.85 * len(t))
    everywhere = [x for _, other in own.items for x in set(other)]
    order = sorted(range(len(t)), key=lambda i: (t.count(t[i]) * everywhere.count(t[i]), everywhere.count(t[i]), t.index(t[i])))
    changed = list(t)
    for i in order[:spare]:
        changed[i] = 10**6 + i
    doc = [*range(50), *changed, *range(100, 150)]
    assert len(licenses.align(t, changed)) >= 0.85 * len(t)
    found = own.scan(doc, [p for p, x in enumerate(doc) if x in own.cues], 0.85, 0.6)
    assert any(f[1] >= 50 and f[2] < 50 + len(t) for f in found)


@pytest.mark.parametrize("name", ["LGPL-3.0", "AGPL-3.0"])
@pytest.mark.parametrize("changed", [0, 1, 2])
def test_a_licence_also_inside_another_is_found_where_it_stands_alone(name, changed):
    own = licenses.Templates(licenses.NOTICES)
    text = {k: t for k, t in own.items}  # the last template of each licence
    alone = list(text[name])
    for i in range(changed):
        alone[5 + 10 * i] = 10**6 + i
    doc = [*text["GPL-3.0"], *range(100), *alone]
    found = {f[0]: f[1:] for f in own.scan(doc, [p for p, x in enumerate(doc) if x in own.cues], 0.85, 0.6)}
    assert found["GPL-3.0"][:2] == (0, len(text["GPL-3.0"]) - 1)
    assert found[name][0] >= len(text["GPL-3.0"]) + 100


@pytest.mark.parametrize("cue_at", ["first", "last"])
def test_a_notice_with_many_words_put_in_is_found_from_any_cue(cue_at):
    """The place is 1.5 times as long as the template; a single cue stands at one end of it."""
    own = licenses.Templates(licenses.NOTICES)
    name, t = max(own.items, key=lambda x: len(x[1]))
    doc, new = [*range(40)], 10**6
    for i, x in enumerate(t):
        doc.append(x)
        if i % 2:
            doc.append(new + i)
    doc += range(40)
    spots = [p for p, x in enumerate(doc) if own.cues.get(x) and any(own.items[k] == (name, t) for k in own.cues[x])]
    found = own.scan(doc, [spots[0] if cue_at == "first" else spots[-1]], 0.85, 0.6)
    assert [(f[0], f[3]) for f in found if f[0] == name] == [(name, len(t))]


def brute_scan(own, doc, coverage, density):
    """Licences any of whose templates are covered by an alignment of some window of the document."""
    found = set()
    for name, t in own.items:
        for n in {len(t), math.ceil(len(t) / density)}:
            for low in range(0, max(1, len(doc) - n + 1)):
                pairs = licenses.align(t, doc[low : low + n])
                if len(pairs) >= coverage * len(t) and len(pairs) >= density * (pairs[-1][1] - pairs[0][1] + 1):
                    found.add(name)
    return found


def test_scan_equals_brute_force_on_small_templates():
    rng = random.Random(15)
    notices = {"A": ["alpha beta gamma delta epsilon zeta eta theta"], "B": ["one two three four one five six seven nine ten"], "C": ["red green blue red green pink"]}
    own = licenses.Templates(notices, 0.75)
    texts = {name: t for name, t in own.items}
    for _ in range(150):
        doc = [rng.randrange(50) for _ in range(rng.randrange(12))]
        for name in rng.sample(sorted(texts), rng.randrange(0, 3)):
            part = [x if rng.random() < 0.85 else rng.randrange(50) for x in texts[name]]
            for _ in range(rng.randrange(3)):
                part.insert(rng.randrange(len(part)), rng.randrange(50))
            doc += [*part, *(rng.randrange(50) for _ in range(rng.randrange(25)))]
        found = {f[0] for f in own.scan(doc, [p for p, x in enumerate(doc) if x in own.cues], 0.75, 0.6)}
        assert found == brute_scan(own, doc, 0.75, 0.6)
