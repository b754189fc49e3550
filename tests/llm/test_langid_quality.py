import random

from pyspark.sql import functions as F

from strata.llm import langid, quality
from strata.llm.shared import fold


def speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(spark, n=240):
    rng = random.Random(2)
    kinds = {"aa": ["ka", "mi", "to", "ne"], "bb": ["sch", "ung", "ver", "ö"], "cc": ["ción", "ll", "rra", "ñ"]}
    rows = [(i, speech(rng, kinds[k := rng.choice(list(kinds))], rng.randrange(8, 60)), k) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_id_on_held_out_rows(spark, edge_docs, no_docs):
    docs = corpus(spark)
    model = langid.fit(docs, fold() != 2)
    out = langid.apply(docs, model).where(fold() == 2).select("lang", "lang_pred", "lang_score", "rejected").collect()
    assert len(out) > 30 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["lang_score"] <= 1 for r in out) and sum(r["rejected"] for r in out) <= 0.05 * len(out)
    edges = langid.apply(edge_docs, model)
    assert edges.columns[: len(edge_docs.columns)] == edge_docs.columns
    got = edges.collect()
    assert len(got) == edge_docs.count()
    for r in got:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and (not blank or r["lang_score"] == 0 and r["rejected"])
    assert langid.apply(no_docs, model).count() == 0
    empty = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.apply(edge_docs, empty).collect()} == {"und"}


def test_features_are_subwords_of_words():
    a, owner, letters = langid.features(["ab", "", "1"])
    assert letters.tolist() == [2, 0, 0] and set(owner.tolist()) == {0}
    both, _, _ = langid.features(["ab ab"])
    assert sorted(set(both.tolist())) == sorted(set(a.tolist()))


def test_quality_votes(spark, edge_docs, no_docs):
    rng = random.Random(4)
    clean = lambda: ". ".join(speech(rng, ["ka", "mi", "to"], 8).capitalize() for _ in range(5)) + "."
    junk = [lambda: " | ".join(speech(rng, ["ka", "mi"], 1) for _ in range(40)), lambda: speech(rng, ["KA", "MI"], 30).replace(" ", "!! "), lambda: "same " * 60]
    rows = [(i, clean() if i % 3 else rng.choice(junk)(), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels, fold() != 2)
    want = {i: y for i, _, y in rows}
    out = quality.apply(docs, model).where(fold() == 2).collect()
    assert sum((r["score"] >= 0.7) == want[r["doc_id"]] for r in out) >= 0.97 * len(out)
    got = quality.apply(edge_docs, model)
    assert got.count() == edge_docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert [r["score"] for r in got.where("doc_id = 4").collect()] == [model.prior]
    assert quality.apply(no_docs, model).count() == 0
    assert quality.apply(edge_docs, quality.fit(docs, labels.limit(0))).select("score").distinct().first()[0] == 0.5


def test_votes_equal_brute_force(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    texts = [speech(rng, ["ka", "Mi", "to9", "|"], rng.randrange(3, 30)) for _ in range(60)]
    model = quality.train(texts, [i % 2 for i in range(60)])
    x = model.embed(pa.array(texts[:10]))
    for i, s in enumerate(model.score(pa.array(texts[:10]))):
        c = [float(x[i] @ v) for v in model.vectors]
        top = sorted(c, reverse=True)[model.neighbours - 1]
        w = {j: max(cj, 0) for j, cj in enumerate(c) if cj > top + 1e-6}
        ties = [j for j, cj in enumerate(c) if abs(cj - top) <= 1e-6]
        if len(w) + len(ties) == model.neighbours:
            w |= {j: max(c[j], 0) for j in ties}
            assert np.isclose(s, sum(v * model.labels[j] for j, v in w.items()) / sum(w.values()), atol=1e-5)
    assert F is not None


def test_rare_labels_are_taken_whole(spark, monkeypatch):
    """The bound on characters thins the labels with most text only."""
    rows = [(i, "lorem ipsum " * 200, "aa") for i in range(300)] + [(1000 + i, "kort tekst her", "bb") for i in range(4)]
    taken = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: taken.extend(zip(texts, langs)))
    langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), chars=50_000)
    assert sum(x == "bb" for _, x in taken) == 4
    assert 0 < sum(len(t) for t, _ in taken) < 100_000
    assert langid.rates([(10, 100), (10, 1000)], 600, 5000) == [1.0, 1.0]
    assert langid.rates([(10, 100), (1200, 20_000), (600, 10_000)], 600, 4100) == [1.0, 0.1, 0.2]
