"""Generators, workloads, telemetry and the background worker."""

import numpy as np
from pyspark.sql import functions as F

from strata.functions import random as R
from strata.operators import measure
from strata.plans import schedule as S
from strata.plans.schedule import Options
from strata.sources import telemetry, workloads
from strata.sources.maintenance import Worker
from strata.sources.memory import AgentMemory
from strata.sources.store import Store


def split_mix(x):
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
    return x ^ x >> 31


def test_generator(spark):
    values = [0, 1, 2**63 - 1, 12345]
    assert [int(v) for v in R.scramble(np.array(values, np.uint64))] == [split_mix(v) for v in values]
    assert R.random_bytes(5, 9) == bytes(split_mix(5 + i) & 255 for i in range(9))
    got = spark.createDataFrame([(v,) for v in values], "x bigint").select("x", R.scrambled("x").alias("y")).collect()
    assert all(r["y"] % (1 << 64) == split_mix(r["x"]) for r in got)
    assert sorted(R.permuted(100).tolist()) == list(range(100))


def test_operations(spark):
    a = workloads.operations(spark, "burst-recovery", 500, 64, read_percent=30, seed=9)
    rows = a.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, workloads.operations(spark, "burst-recovery", 500, 64, read_percent=30, seed=9).repartition(5).collect()))
    for r in rows:
        x = split_mix(9 ^ split_mix(r["id"]) ^ split_mix(r["number"]))
        assert r["is_read"] == (x % 100 < {0: 30, 1: 0, 2: 95}[r["number"]])
        assert bytes(r["k"]) == (split_mix(x) % 64).to_bytes(8, "big")
    s = workloads.operations(spark, "sequential-write", 10, 4).orderBy("id").collect()
    assert [bytes(r["k"])[-1] for r in s] == [i % 4 for i in range(10)] and not any(r["is_read"] for r in s)


def test_phases_replay(spark):
    g, modes = S.Governor(), []
    for r in workloads.phase_samples(spark, 6).orderBy("step").collect():
        g = g.observe(S.Sample(r["l0"], r["l0_stall"], r["max_debt_ratio"], r["probes_per_get"], r["backlog_levels"]))
        modes.append((r["step"], g.mode.value))
    assert {m for _, m in modes} == {"balanced", "read_protect", "write_emergency"}
    trace = spark.createDataFrame([("t", i, m) for i, m in modes], "t string, step int, mode string")
    assert measure.mode_switches(trace, ["t"], "step", "mode").first()["switches"] == sum(a[1] != b[1] for a, b in zip(modes, modes[1:]))


def test_suite_and_sinks(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), Options(l0_compaction_trigger=2, l0_write_stall_trigger=4)) as s:
        rows = workloads.run_suite(AgentMemory(s), 70, 4, k=3)
        assert len(rows) == 70 + 4 * 4
        for i in range(3):
            s.put(b"x%d" % i, b"y" * 10)
            s.flush(maintain=False)
        worker = Worker(s)
        assert worker.drain() >= 1 and worker.drain() == 0
        worker = Worker(s, 0.01).start()
        worker.wake()
        worker.stop()
        telemetry.write_state(s, str(tmp_path / "t"), "end")
        telemetry.write_stage_rows(spark.createDataFrame(rows), str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t/levels")).count() >= 1
    assert spark.read.option("header", True).csv(str(tmp_path / "t/decisions")).select(F.col("gap_before")).count() >= 1
    got = spark.read.json(str(tmp_path / "j")).collect()
    assert {(r["stage"], r["op"]) for r in got} >= {("remember", "write"), ("recall-by-id", "read"), ("recent-for-agent", "recent")} and all(r["p50"] <= r["p99"] for r in got)
