"""The pipeline's stages on a small corpus, against what each should keep."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from strata.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    rng = random.Random(11)
    kinds = {"en": ["the", "ing", "er", "st", "wh"], "de": ["sch", "ung", "ver", "ge"], "fr": ["eau", "que", "oi", "ai"]}
    line = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randrange(2, 6))) for _ in range(n))
    rows = []
    for i in range(150):
        k = rng.choice(list(kinds))
        rows.append((i, "\n".join(line(k, 20) for _ in range(4)), k, "s", 0))
    item = line("en", 30)
    rows += [(200, rows[0][1], "en", "s", 0), (201, "12 34 !!", "en", "s", 0), (202, None, "en", "s", 0), (203, line("en", 30) + "\n" + item, "en", "s", 0), (204, rows[1][1].split("\n")[0] + "\n" + line("fr", 25), "fr", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    clean = set(range(150))
    assert clean <= set(kept["language_id"]) and not {201, 202} & set(kept["language_id"])
    assert 200 not in kept["line_dedup"] and clean <= set(kept["line_dedup"]) and len(kept["line_dedup"][204]["text"].split("\n")) == 1
    assert clean <= set(kept["near_dedup"])
    assert 203 in kept["near_dedup"] and 203 not in kept["decontamination"] and clean <= set(kept["decontamination"])
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in kept["byte_bpe"].values())


def test_clashing_columns_come_through(spark, folder):
    """Extra columns named as what stages use inside keep their values."""
    names = ["lang_pred", "lang_score", "Rejected", "_removed", "_doc", "_hash", "_hash2", "_new", "_node", "_other", "items", "coverages", "ids", "decoded", "rid", "removed", "root", "node", "key", "first"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]


def test_empty_and_repeated_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    twice, base = docs.union(docs), {}
    for name, stage in corpus_pipeline.STAGES:
        base[name] = stage(spark, docs, folder)
    stages = dict(corpus_pipeline.STAGES)
    key = ["doc_id", "text"]
    for name in ("line_dedup", "near_dedup"):
        assert sorted(map(tuple, stages[name](spark, twice, folder).select(*key).collect()), key=repr) == sorted(map(tuple, base[name].select(*key).collect()), key=repr)
    assert stages["decontamination"](spark, twice, folder).count() == 2 * base["decontamination"].count()
    assert stages["byte_bpe"](spark, twice, folder).count() == 2 * base["byte_bpe"].count()


def test_run_equals_stages(spark, folder):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} >= set(range(150))


def test_registry():
    assert all(any(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 11)) and "pipeline" in QUERIES
    assert set(ORACLE_SQL) <= set(QUERIES)
