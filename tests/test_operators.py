"""Resolution, batches, schedulers and measurements against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import measure, resolve
from strata.operators.batch import sequenced
from strata.plans import schedule as S
from strata.schema import LOG_SCHEMA
from strata.sources.manifest import Manifest, Run
from strata.streaming.upsert import into_store, latest_by_key
from strata.sources.store import Store


def log_of(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, t, None if v is None else bytearray(v)) for k, s, t, v in rows], LOG_SCHEMA)


@pytest.fixture(scope="module")
def versions():
    rng = random.Random(3)
    return [(bytes([200 + rng.randrange(20)]), s, t := 1 + (rng.random() < 0.3), None if t == 2 else b"%d" % s) for s in range(1, 201)]


def model(rows, at):
    out = {}
    for k, s, t, v in sorted(rows, key=lambda r: r[1]):
        if s <= at:
            out.pop(k, None) if t == 2 else out.__setitem__(k, v)
    return out


def test_resolution_commutes(spark, versions):
    log = log_of(spark, versions)
    for at in (0, 1, 77, 200):
        got = {bytes(r["k"]): bytes(r["v"]) for r in resolve.live(log, at).collect()}
        assert got == model(versions, at)
    a, b = log.where("seq <= 90"), log.where("seq > 90")
    parts = resolve.live(resolve.merged(resolve.compacted(a), resolve.newest(b)))
    assert {bytes(r["k"]): bytes(r["v"]) for r in parts.collect()} == model(versions, 200)
    kept = resolve.retained(log, 120)
    for at in (120, 150, 200):
        assert {bytes(r["k"]): bytes(r["v"]) for r in resolve.live(kept, at).collect()} == model(versions, at)
    assert resolve.live(log.limit(0)).count() == 0


def test_as_of(spark, versions):
    probes = [(i, bytearray([200 + i % 22]), i * 9) for i in range(25)]
    got = resolve.as_of(spark.createDataFrame(probes, "id int, k binary, at_seq bigint"), log_of(spark, versions)).collect()
    assert len(got) == 25
    for r in got:
        want = model(versions, r["at_seq"]).get(bytes(r["k"]))
        assert r["found"] == (want is not None) and (want is None or bytes(r["v"]) == want)


def test_sequences_are_contiguous(spark):
    ops = spark.range(1000).repartition(7).select(F.lit("put").alias("op"), F.lit("k").cast("binary").alias("k"), F.col("id").cast("string").cast("binary").alias("v"), F.col("id").alias("ord"))
    got = sequenced(ops, 50).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(51, 1051)) and [int(r["v"]) for r in got] == list(range(1000))


def run(number, level, low, high, size=100):
    return Run(f"f{number}", level, number, size, 1, low, high, 1, 1)


def test_plans():
    o = S.Options(l0_compaction_trigger=2, l0_write_stall_trigger=4, base_level_bytes=150, level_multiplier=2, scheduler="fixed")
    runs = (run(5, 0, b"a", b"f"), run(6, 0, b"d", b"k"), run(1, 1, b"a", b"c"), run(2, 1, b"m", b"p"), run(3, 2, b"a", b"z"))
    m = Manifest(runs=runs, next_number=9)
    plan, _ = S.fixed(m, o)
    assert plan.inputs == (6, 5, 1) and plan.output_level == 1 and not plan.drop_deletes
    calm = Manifest(runs=runs[2:], next_number=9)
    plan, level = S.fixed(calm, o)
    assert plan.inputs == (1, 3) and plan.output_level == 2 and level == 2 and not plan.drop_deletes
    assert S.rewrite(calm.runs, 2).drop_deletes
    assert S.scored(m, o).source_level == 0 and S.scored(calm, o).source_level == 1
    assert S.scored(Manifest(runs=runs[4:]), S.Options()) is None
    moves = [c for c in S.candidates(Manifest(runs=(run(1, 1, b"a", b"c"), run(2, 1, b"m", b"p")), next_number=3), o) if c.kind == "move"]
    assert moves and moves[0].numbers == (1, 2)
    plan, g, d = S.governed(m, o, S.Governor(), 0.0, 1)
    assert plan.source_level == 0 and d.tier == "l0" and g.focus is None
    plan, g, d = S.governed(calm, o, S.Governor(), 0.0, 2)
    assert plan.output_level == 2 and d.tier == "focus_reselected" and g.focus == 1


def test_governor_modes():
    g = S.Governor()
    calm = S.Sample(0, 8, 0.0, 0.0, 0)
    assert g.observe(S.Sample(6, 8, 0.0, 0.0, 0)).mode is S.Mode.WRITE_EMERGENCY
    hot = g.observe(S.Sample(0, 8, 3.0, 0.0, 0))
    assert hot.mode is S.Mode.WRITE_EMERGENCY and hot.switches == 1
    for expected in (S.Mode.WRITE_EMERGENCY, S.Mode.WRITE_EMERGENCY, S.Mode.BALANCED):
        hot = hot.observe(calm)
        assert hot.mode is expected
    reads = S.Sample(0, 8, 0.0, 10.0, 0)
    for expected in (S.Mode.BALANCED, S.Mode.BALANCED, S.Mode.READ_PROTECT):
        g = g.observe(reads)
        assert g.mode is expected
    assert abs(g.probes - 10 * (1 - 0.7**3)) < 1e-9
    while g.probes > 1.15:
        g = g.observe(calm)
        assert g.mode is S.Mode.READ_PROTECT
    for _ in range(3):
        g = g.observe(calm)
    assert g.mode is S.Mode.BALANCED
    assert S.Governor().delay_us() == 20 and S.Governor(pressure=1.0).delay_us() == 5 and S.Governor(mode=S.Mode.READ_PROTECT).delay_us() == 40


def test_histogram_buckets(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 100, 1000, 123456789, 1 << 40]
    got = {r["ns"]: (r["b"], r["t"]) for r in spark.createDataFrame([(v,) for v in values], "ns bigint").select("ns", measure.bucket(F.col("ns")).alias("b")).withColumn("t", measure.bucket_top(F.col("b"))).collect()}
    for v in values:
        assert got[v][0] == measure.bucket_value(v) and v <= got[v][1] <= v + v // 32 + 1
    ordered = [got[v][0] for v in values]
    assert ordered == sorted(ordered)


def test_stream_into_store(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.lit("put").alias("op"), F.format_string("k%02d", F.col("id") % 15).alias("k"), F.col("id").cast("string").alias("v"), F.col("id").alias("ord")).coalesce(1).write.mode("append").parquet(str(src))
    with Store(spark, str(tmp_path / "s")) as s:
        for _ in range(2):
            stream = spark.readStream.schema("op string, k string, v string, ord bigint").option("maxFilesPerTrigger", 1).parquet(str(src))
            into_store(stream, s, "t", str(tmp_path / "cp")).awaitTermination(120)
        got = {bytes(r["k"]): bytes(r["v"]) for r in s.prefix(b"k").collect()}
        assert set(got) == {b"k%02d" % i for i in range(15)} and got[b"k14"] == b"29" and s.last_seq == 33
    log = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, None)], "k string, seq bigint, kind int, v string")
    assert latest_by_key(log).first()["seq"] == 2


def test_free_runs_are_found_without_all_pairs(monkeypatch):
    rng = random.Random(5)

    def some(first, level, n):
        bounds = [rng.randbytes(2) for _ in range(2 * n)]
        return [run(first + i, level, *sorted(bounds[2 * i : 2 * i + 2])) for i in range(n)]

    for n in (0, 1, 4, 40):  # also runs that overlap within a level
        own, below = some(1, 1, 40), some(100, 2, n)
        assert S.unmet(own, below) == [r for r in own if not any(b.overlaps(r.min_k, r.max_k) for b in below)]
    calls, real = [], Run.overlaps
    monkeypatch.setattr(Run, "overlaps", lambda *a: calls.append(1) or real(*a))
    upper = [run(i, 1, b"%05d" % (4 * i), b"%05d" % (4 * i + 1)) for i in range(1, 1001)]
    lower = [run(2000 + i, 2, b"%05d" % (4 * i + 2), b"%05d" % (4 * i + 3)) for i in range(1, 1001)]
    found = S.candidates(Manifest(runs=(*upper, *lower), next_number=9000), S.Options(base_level_bytes=1000))
    assert [c.numbers for c in found if c.kind == "move"][0] == tuple(range(1, 9)) and len(calls) < 100_000


def test_lone_runs_move_unless_deletions_can_go():
    o = S.Options(base_level_bytes=150, level_multiplier=2, scheduler="scored")
    a, b = run(1, 1, b"a", b"c"), run(2, 1, b"m", b"p")
    gone = Run("f1", 1, 1, 100, 1, b"a", b"c", 1, 1, 1)
    below = run(3, 2, b"x", b"z")
    plan = S.scored(Manifest(runs=(a, b), next_number=9), o)
    assert plan.inputs == (1,) and plan.move and plan.predicted_bytes == 0
    assert not S.scored(Manifest(runs=(gone, b), next_number=9), o).move  # the last level: a rewrite drops the deletion
    deeper = run(4, 3, b"a", b"c")
    assert S.scored(Manifest(runs=(gone, b, below, deeper), next_number=9), o).move
    assert not S.scored(Manifest(runs=(a, b, run(3, 2, b"b", b"z")), next_number=9), o).move
    assert not S.rewrite((run(5, 0, b"a", b"f"),), 0).move  # level 0 has hidden versions
