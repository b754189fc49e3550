"""Sinks for measurements: samples, levels and decisions as CSV, result rows as JSON lines."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import measure
from strata.sources.store import Store


def samples(store: Store, stage: str) -> DataFrame:
    """One row of the store's counters and signals now."""
    s = store.stats()
    flat = {k: (float(v) if isinstance(v, (int, float)) else str(v)) for k, v in s.items() if v is not None}
    return store.spark.createDataFrame([flat | {"stage": stage, "at": time.time()}])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def write_stage_rows(latencies: DataFrame, path: str) -> None:
    """Percentiles by stage and kind of call, as JSON lines."""
    counts = measure.histogram(latencies, ["stage", "op"])
    measure.histogram_percentiles(counts, ["stage", "op"]).withColumn("type", F.lit("stage")).write.mode("append").json(path)


def write_state(store: Store, folder: str, stage: str) -> None:
    """samples, levels and decisions of a store."""
    write_csv(samples(store, stage), f"{folder}/samples")
    write_csv(store.level_stats().withColumn("stage", F.lit(stage)), f"{folder}/levels")
    trace = store.trace_frame().withColumn("stage", F.lit(stage))
    write_csv(measure.gaps(trace, ["stage"], "sequence"), f"{folder}/decisions")
