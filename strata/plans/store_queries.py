"""Queries that load a store in the shared folder and read it back, with SQL over the same operations.

Events are the operations, in order of event_id: errors delete a user's key, others put it. They are written as bulk batches of
equal ranges of event_id. Each query has a store of its own and leaves its files for the DataFrame that reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.operators import stats as S
from strata.plans.schedule import Options
from strata.sources.logs import scratch, table
from strata.sources.memory import AgentMemory, record_key
from strata.sources.store import Store

EVENTS = "ev AS (SELECT 'user/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS k, row_number() OVER (ORDER BY event_id) AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind, event_type AS v FROM events)"


def newest(where: str = "TRUE") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM ev WHERE {where}) WHERE rn = 1)"


LIVE = f"SELECT k, seq, v FROM {newest()} WHERE kind = 1"
HALF = "seq <= (SELECT count(*) FROM events WHERE event_id < (SELECT min(event_id) + (max(event_id) - min(event_id) + 1) // 2 FROM events))"
#: Compaction after few runs, so that whole schedules run on small tables.
SMALL = {"l0_compaction_trigger": 2, "l0_write_stall_trigger": 6, "base_level_bytes": 16 << 10, "level_multiplier": 4, "target_file_bytes": 8 << 10}


def _operations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    gone = F.col("event_type") == "error"
    return e.select(F.when(gone, "delete").otherwise("put").alias("op"), K.padded("user/", F.col("user_id"), 6).alias("k"), F.when(~gone, F.col("event_type")).alias("v"), F.col("event_id").alias("ord"))


def _loaded(spark: SparkSession, d: str, parts: int, options: Options | None = None, between=None) -> Store:
    """A store with all events, written as ``parts`` batches; ``between`` is called with the store after each."""
    store, ops = Store(spark, scratch(spark), options), _operations(spark, d)
    low, high = ops.agg(F.min("ord"), F.max("ord")).first()
    if low is not None:
        cuts = [low + (high - low + 1) * i // parts for i in range(parts + 1)]
        for a, b in zip(cuts, cuts[1:]):
            store.write_frame(ops.where((F.col("ord") >= a) & (F.col("ord") < b)))
            if between:
                between(store)
    return store


def _text(rows: DataFrame) -> DataFrame:
    """Keys and values as text."""
    return rows.withColumns({c: F.col(c).cast("string") for c in ("k", "v") if c in rows.columns})


def _read(store: Store, rows: DataFrame) -> DataFrame:
    store.close()
    return _text(rows)


def _scheduled(scheduler: str):
    def run(spark, d):
        s = _loaded(spark, d, 6, Options(scheduler=scheduler, **SMALL))
        if not s.counters["compactions"]:
            raise RuntimeError("no compaction ran")
        return _read(s, s.scan())

    return run


def store_scan(spark, d):
    s = _loaded(spark, d, 2)
    return _read(s, s.scan())


def store_raw(spark, d):
    s = _loaded(spark, d, 3)
    return _read(s, s.raw()).select("k", "seq", F.col("kind").cast("int").alias("kind"))


def store_snapshot(spark, d):
    """What a snapshot after the first half sees, once the second half and a full compaction have come."""
    held = []
    s = _loaded(spark, d, 2, between=lambda x: held.append(x.snapshot()))
    s.compact_all()
    return _read(s, s.scan(snapshot=held[0]))


def store_compacted(spark, d):
    """All that is left in the files after a full compaction."""
    s = _loaded(spark, d, 3)
    s.compact_all()
    return _read(s, s.log().select("k", "seq", "v"))


def store_run_totals(spark, d):
    s = _loaded(spark, d, 3)
    s.compact_all()
    return s.runs_frame().agg(F.sum("rows").alias("rows"), F.sum("tombstones").alias("tombstones"), F.max("max_seq").alias("max_seq"))


def store_backup(spark, d):
    s, to = _loaded(spark, d, 2), f"{scratch(spark)}-copy"
    s.backup(to)
    s.close()
    copy = Store(spark, to)
    return _read(copy, copy.scan())


def store_range(spark, d):
    s = _loaded(spark, d, 2)
    return _read(s, s.scan(b"user/000020", b"user/000090"))


def store_prefix(spark, d):
    s = _loaded(spark, d, 2)
    return _read(s, s.prefix(b"user/00001"))


def store_range_limit(spark, d):
    s = _loaded(spark, d, 2)
    return _read(s, s.range_values(b"user/000050", None, 17)).select("k", "v")


def store_history(spark, d):
    """All versions of a key; bulk loads without compaction keep them."""
    s = _loaded(spark, d, 2, Options(l0_compaction_trigger=50, l0_write_stall_trigger=60))
    return _read(s, s.history(b"user/000007")).select("k", "seq", F.col("kind").cast("int").alias("kind"), "v")


def store_multi_get(spark, d):
    s = _loaded(spark, d, 2)
    wanted = table(spark, d, "customer").select(K.padded("user/", F.col("c_custkey"), 6).cast("binary").alias("k"))
    return _read(s, s.multi_get(wanted)).select("k", "found", "seq", "v")


def store_integrity(spark, d):
    s = _loaded(spark, d, 4, Options(**SMALL))
    found = s.check_integrity()
    s.close()
    return spark.createDataFrame([(found["live_keys"], found["live_bytes"])], "live_keys bigint, live_bytes bigint")


def store_recovered(spark, d):
    """Nations written one by one, some deleted, all synced; one more is not. The store is opened anew and replays its logs."""
    path = scratch(spark)
    s = Store(spark, path)
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():
        s.put(b"nation/%04d" % r["n_nationkey"], r["n_name"].encode())
        if r["n_regionkey"] == 1:
            s.delete_durable(b"nation/%04d" % r["n_nationkey"])
    s.sync()
    s.put(b"nation/9999", b"never synced")
    s._unsynced.clear()  # as if the process ended here
    s.close()
    s = Store(spark, path)
    return _read(s, s.scan()).select("k", "v")


def store_memory(spark, d):
    """Suppliers as memories of agents; the latest five of agent 3."""
    s = Store(spark, scratch(spark))
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey").collect()
    s.write([("put", record_key(r["s_suppkey"]), b'{"memory_id": "m%d", "agent": %d, "created_at": %d, "revision": 1, "text": "%s"}' % (r["s_suppkey"], r["s_suppkey"] % 64, r["s_suppkey"], r["s_name"].encode())) for r in rows])
    out = AgentMemory(s).recent(3, 5).select("memory_id", F.col("created_at").cast("bigint").alias("created_at"), "text")
    s.flush()
    s.close()
    return out


def key_hashes(spark, d):
    """CRC-32 is Spark's own; FNV-1a by columns."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.hex(K.fnv1a(F.col("c_name").cast("binary"))).alias("fnv"))


def average_batch(spark, d):
    """Operations of each batch on average, orders being batches of lines."""
    batches = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("operations"))
    return batches.agg(F.round(S.average_batch(F.col("operations")), 6).alias("average"))


#: Names are ASCII text here, so their characters are their bytes.
_FNV = "list_reduce(list_transform(range(1, length(c_name) + 1), lambda i: CAST(unicode(substr(c_name, CAST(i AS INTEGER), 1)) AS UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"

STORE = {
    store_scan: f"WITH {EVENTS} {LIVE}",
    store_raw: f"WITH {EVENTS} SELECT k, seq, kind FROM {newest()}",
    store_snapshot: f"WITH {EVENTS} SELECT k, seq, v FROM {newest(HALF)} WHERE kind = 1",
    store_compacted: f"WITH {EVENTS} {LIVE}",
    store_run_totals: f"WITH {EVENTS} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS tombstones, max(seq) AS max_seq FROM ({LIVE})",
    store_backup: f"WITH {EVENTS} {LIVE}",
    store_range: f"WITH {EVENTS} SELECT * FROM ({LIVE}) WHERE k >= 'user/000020' AND k < 'user/000090'",
    store_prefix: f"WITH {EVENTS} SELECT * FROM ({LIVE}) WHERE starts_with(k, 'user/00001')",
    store_range_limit: f"WITH {EVENTS} SELECT k, v FROM ({LIVE}) WHERE k >= 'user/000050' ORDER BY k LIMIT 17",
    store_history: f"WITH {EVENTS} SELECT k, seq, kind, CASE WHEN kind = 1 THEN v END AS v FROM ev WHERE k = 'user/000007'",
    store_multi_get: f"WITH {EVENTS}, w AS (SELECT DISTINCT 'user/' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS k FROM customer) SELECT w.k, l.k IS NOT NULL AS found, l.seq, l.v FROM w LEFT JOIN ({LIVE}) l ON l.k = w.k",
    store_integrity: f"WITH {EVENTS} SELECT count(*) AS live_keys, CAST(sum(length(k) + length(v)) AS BIGINT) AS live_bytes FROM ({LIVE})",
    store_recovered: "SELECT 'nation/' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS k, n_name AS v FROM nation WHERE n_regionkey <> 1",
    store_memory: "SELECT 'm' || s_suppkey AS memory_id, CAST(s_suppkey AS BIGINT) AS created_at, s_name AS text FROM supplier WHERE s_suppkey % 64 = 3 ORDER BY s_suppkey DESC LIMIT 5",
    key_hashes: f"SELECT c_custkey, hex(CAST({_FNV} AS UBIGINT)) AS fnv FROM customer",
    average_batch: "SELECT round(avg(n), 6) AS average FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
}

QUERIES = {f.__name__: f for f in STORE}
ORACLE_SQL = {f.__name__: sql for f, sql in STORE.items()}
for _name in ("fixed", "scored", "governor"):
    QUERIES[f"store_{_name}"], ORACLE_SQL[f"store_{_name}"] = _scheduled(_name), f"WITH {EVENTS} {LIVE}"
