"""Workloads as DataFrames of operations: profiles of stages, phases of load, the agent-memory suite."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.keys import u64_key_of
from strata.functions.random import scramble, scrambled
from strata.sources.memory import AGENTS, AgentMemory


@dataclass(frozen=True)
class Stage:
    """A share of reads in percent, or None for the run's own share; keys in sequence or at random."""

    name: str
    reads: int | None
    sequential: bool = False
    single: bool = False


# The stages of each profile, and duty cycles of writers and readers in six phases.
PROFILES: dict[str, list[Stage]] = {
    "sequential-write": [Stage("sequential-write", 0, sequential=True)],
    "random-write": [Stage("random-write", 0)],
    "random-read": [Stage("random-read", 100)],
    "mixed": [Stage("mixed", None)],
    "update-heavy": [Stage("update-heavy", None)],
    "burst-read": [Stage("write-pressure", 0), Stage("read-heavy", 95)],
    "burst-recovery": [Stage("steady", None), Stage("write-burst", 0), Stage("read-recovery", 95)],
    "concurrency-jump": [Stage("low-concurrency", None, single=True), Stage("high-concurrency", None)],
    "sustained-write": [Stage("sustained-write", 0)],
}
PHASES: dict[str, tuple[float, float, bool]] = {
    "1-read-heavy": (0.05, 1.0, False),
    "2-write-burst": (1.0, 0.05, False),
    "3-mixed": (0.6, 0.6, False),
    "4-overwrite-delete-churn": (1.0, 0.3, True),
    "5-sequential-new-writes": (1.0, 0.3, False),
    "6-read-heavy-recovery": (0.05, 1.0, False),
}
SUITE = ["remember", "recall-by-id", "recent-for-agent", "update", "mixed-90-10"]


def operations(spark: SparkSession, profile: str, count: int, keys: int, *, working_set: int | None = None, read_percent: int = 50, seed: int = 1) -> DataFrame:
    """stage, number, id, is_read and k (8-byte big-endian) of each operation; the same for any partitioning."""
    out = None
    for n, s in enumerate(PROFILES[profile]):
        salt = int((np.uint64(seed) ^ scramble(n)[0]).view(np.int64))
        r = scrambled(F.lit(salt).bitwiseXOR(scrambled("id")))
        ops = spark.range(count).withColumn("r", r)
        unsigned = lambda c, m: F.pmod(F.pmod(F.shiftrightunsigned(c, 1), F.lit(m)) * 2 + c.bitwiseAND(F.lit(1)), F.lit(m))
        key = F.pmod("id", F.lit(keys)) if s.sequential else unsigned(scrambled("r"), working_set or keys)
        reads = read_percent if s.reads is None else s.reads
        one = ops.select(F.lit(s.name).alias("stage"), F.lit(n).alias("number"), "id", (unsigned(F.col("r"), 100) < reads).alias("is_read"), u64_key_of(key).alias("k"))
        out = one if out is None else out.unionByName(one)
    return out


def phase_samples(spark: SparkSession, steps: int, l0_stall: int = 8) -> DataFrame:
    """Pressure samples of the six phases, for replay through the governor."""
    rows = []
    for p, (name, (write, read, churn)) in enumerate(PHASES.items()):
        for i in range(steps):
            rows.append((p * steps + i, name, int(write * l0_stall * (0.6 + 0.4 * (i % 3) / 2)), l0_stall, 1.0 + write * (2.5 if churn else 1.2), 1.0 + read * 1.5, int(write > 0.5) + int(churn)))
    return spark.createDataFrame(rows, "step int, phase string, l0 int, l0_stall int, max_debt_ratio double, probes_per_get double, backlog_levels int")


def run_suite(memory: AgentMemory, records: int, calls: int, *, k: int = 10, seed: int = 1) -> list[dict]:
    """The five stages against a store, each call verified; a row of latencies for each call."""
    revisions: dict[int, int] = {}
    out: list[dict] = []

    def timed(stage: str, op: str, call: Callable):
        t = time.perf_counter_ns()
        got = call()
        out.append({"stage": stage, "op": op, "ns": time.perf_counter_ns() - t})
        return got

    for n, stage in enumerate(SUITE):
        for op in range(records if n == 0 else calls):
            record = op if n == 0 else int(scramble(int(np.uint64(seed) ^ scramble(n)[0] ^ np.uint64(op)))[0] % np.uint64(records))
            if n in (0, 3) or n == 4 and op % 10 == 9:
                revisions[record] = revisions.get(record, 0) + 1
                timed(stage, "write", lambda: memory.remember(record, f"text of {record}", revisions[record], durable=False))
            elif n == 2:
                got = timed(stage, "recent", lambda: memory.recent(record % AGENTS, k).collect())
                want = sorted((r for r in revisions if r % AGENTS == record % AGENTS), reverse=True)[:k]
                assert [(r["memory_id"], int(r["revision"])) for r in got] == [(f"m{r}", revisions[r]) for r in want]
            else:
                got = timed(stage, "read", lambda: memory.recall(record))
                assert got is not None and got.revision == revisions[record]
        memory.store.sync()
    return out
