"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one.
All but the last return the columns of documents, and extra columns as they are, whatever their names; the last leaves extra columns out.
Null and empty texts go in the first stage, as no language is told. Repeated rows lose all their lines but in the first of them. An
empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, dartminhash, decontaminate, langid, linededup
from strata.llm.shared import free_names, stored


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a calibrated score; those rejected go."""
    names = free_names(docs, "lang_pred", "lang_score", "rejected")
    return langid.apply(docs, langid.fit(docs), names).where(~F.col(names[2])).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches; documents left without words go."""
    return linededup.without_repeats(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the least doc_id, then the least text."""
    return dartminhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    names = free_names(docs, "items", "coverages")
    out = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names=names)
    return out.where(F.size(names[0]) == 0).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and whether they decode to the text by the UTF-8 automaton."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), back=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: SQL expresses neither the classifier nor the tokeniser; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
