"""The queries of the engine by name, with equivalent SQL.

Keys are ASCII text here, whose order is the order of their bytes. Each entry is (query, SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.operators import batch as B
from strata.operators import measure as M
from strata.operators import reads as R
from strata.operators import resolve as V
from strata.operators import stats as S
from strata.plans import store_queries
from strata.sources.logs import events_log, lines_log, runs_of, table, turns_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_EV = "ev AS (SELECT 'user/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind, event_type AS v FROM events)"
_LI = """li AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS seq, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS kind, l_linestatus AS v
 FROM (SELECT *, 'order/' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '/line/' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS k FROM lineitem))"""
_CV = "cv AS (SELECT 'conv/' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '/' || lpad(CAST(9999 - turn AS VARCHAR), 4, '0') AS k, conv_id * 10000 + turn + 1 AS seq, 1 AS kind, role || ':' || CAST(length(text) AS VARCHAR) AS v, conv_id FROM conversations)"
_CUT = 5000


def _newest(log: str, where: str = "TRUE") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM {log} WHERE {where}) WHERE rn = 1)"


def _live(log: str, where: str = "TRUE") -> str:
    return f"(SELECT k, seq, v FROM {_newest(log, where)} WHERE kind = 1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# Resolution -----------------------------------------------------------------------------------


@query(f"WITH {_EV} SELECT * FROM {_live('ev')}")
def live_state(spark, d):
    return V.live(events_log(spark, d)).select("k", "seq", "v")


@query(f"WITH {_LI} SELECT * FROM {_live('li')}")
def live_lines(spark, d):
    return V.live(lines_log(spark, d)).select("k", "seq", "v")


@query(f"WITH {_EV} SELECT k, seq, kind, v FROM {_newest('ev')}")
def raw_state(spark, d):
    return V.newest(events_log(spark, d)).select("k", "seq", "kind", "v")


@query(f"WITH {_EV} SELECT * FROM {_live('ev', f'seq <= {_CUT}')}")
def snapshot_state(spark, d):
    return V.live(events_log(spark, d), _CUT).select("k", "seq", "v")


@query(f"WITH {_EV} SELECT k, seq FROM {_live('ev')}")
def live_keys(spark, d):
    return V.live_keys(events_log(spark, d))


@query(f"WITH {_EV} SELECT k, seq, kind, v FROM ev WHERE k = 'user/000007'")
def history_of_key(spark, d):
    return V.history(events_log(spark, d), "user/000007").select("k", "seq", "kind", "v")


@query(f"WITH {_EV} SELECT k, count(*) AS versions, CAST(count(*) FILTER (kind = 2) AS BIGINT) AS deletes, max(seq) AS newest FROM ev GROUP BY k")
def version_counts(spark, d):
    return events_log(spark, d).groupBy("k").agg(F.count("*").alias("versions"), F.count_if(F.col("kind") == 2).alias("deletes"), F.max("seq").alias("newest"))


@query(f"WITH {_EV}, {_CV} SELECT k, seq, kind FROM ev UNION ALL SELECT k, seq, kind FROM cv")
def merge_sources(spark, d):
    return V.merge_ordered(events_log(spark, d), turns_log(spark, d).drop("conv_id")).select("k", "seq", "kind")


@query(f"WITH {_EV}, p AS (SELECT user_id, event_id, event_id - 500 AS at_seq, 'user/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS k FROM events), m AS (SELECT p.event_id, arg_max(e.kind, e.seq) AS kind, max(e.seq) AS seq, arg_max(e.v, e.seq) AS v FROM p JOIN ev e ON e.k = p.k AND e.seq <= p.at_seq GROUP BY p.event_id) SELECT p.event_id, p.k, p.at_seq, coalesce(m.kind = 1, FALSE) AS found, CASE WHEN m.kind = 1 THEN m.seq END AS seq, CASE WHEN m.kind = 1 THEN m.v END AS v FROM p LEFT JOIN m ON m.event_id = p.event_id")
def as_of_join(spark, d):
    log = events_log(spark, d)
    probes = table(spark, d, "events").select("event_id", K.padded("user/", F.col("user_id"), 6).alias("k"), (F.col("event_id") - 500).alias("at_seq"))
    return V.as_of(probes, log).select("event_id", "k", "at_seq", "found", "seq", "v")


@query(f"WITH {_EV}, t AS (SELECT *, max(seq) FILTER (seq <= {_CUT}) OVER (PARTITION BY k) AS top FROM ev) SELECT k, seq, kind FROM t WHERE seq > {_CUT} OR seq = top")
def retained_versions(spark, d):
    return V.retained(events_log(spark, d), _CUT).select("k", "seq", "kind")


@query(f"WITH {_EV}, b AS (SELECT 'user/' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS k, (SELECT max(seq) FROM ev) + row_number() OVER (ORDER BY c_custkey) AS seq, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS kind, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS v FROM customer), u AS (SELECT * FROM ev UNION ALL SELECT * FROM b) SELECT * FROM {_live('u')}")
def batch_apply(spark, d):
    log = events_log(spark, d)
    c = table(spark, d, "customer")
    gone = F.col("c_custkey") % 3 == 0
    batch = c.select(F.when(gone, "delete").otherwise("put").alias("op"), K.padded("user/", F.col("c_custkey"), 6).alias("k"), F.when(~gone, F.col("c_mktsegment")).alias("v"), F.col("c_custkey").alias("ord"))
    last = log.agg(F.max("seq")).first()[0]
    return V.live(V.applied(log, batch, last)).select("k", "seq", "v")


@query(f"WITH {_EV}, t AS (SELECT k, min(seq) FILTER (kind = 2) AS first_delete, max(seq) FILTER (kind = 1) AS last_put FROM ev GROUP BY k) SELECT k, first_delete, last_put FROM t WHERE first_delete < last_put")
def delete_then_put(spark, d):
    t = events_log(spark, d).groupBy("k").agg(F.min(F.when(F.col("kind") == 2, F.col("seq"))).alias("first_delete"), F.max(F.when(F.col("kind") == 1, F.col("seq"))).alias("last_put"))
    return t.where("first_delete < last_put")


@query(f"WITH {_EV} SELECT k, seq FROM {_newest('ev')} WHERE kind = 2")
def deleted_keys(spark, d):
    return V.newest(events_log(spark, d)).where("kind = 2").select("k", "seq")


@query(f"WITH {_EV}, a AS (SELECT * FROM {_live('ev', f'seq <= {_CUT}')}), b AS (SELECT * FROM {_live('ev')}) SELECT coalesce(a.k, b.k) AS k, a.v AS before, b.v AS after, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def diff_snapshots(spark, d):
    log = events_log(spark, d)
    return V.diff(V.live(log, _CUT), V.live(log))


# Reads ----------------------------------------------------------------------------------------


@query(f"WITH {_EV} SELECT * FROM {_live('ev')} WHERE k = 'user/000011'")
def point_get(spark, d):
    return R.get(events_log(spark, d), "user/000011")


@query(f"WITH {_EV} SELECT * FROM {_live('ev', f'seq <= {_CUT}')} WHERE k = 'user/000011'")
def point_get_at(spark, d):
    return R.get(events_log(spark, d), "user/000011", _CUT)


@query(f"WITH {_EV}, w AS (SELECT DISTINCT 'user/' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS k FROM customer) SELECT w.k, l.k IS NOT NULL AS found, l.seq, l.v FROM w LEFT JOIN {_live('ev')} l ON l.k = w.k")
def multi_get_found(spark, d):
    wanted = table(spark, d, "customer").select(K.padded("user/", F.col("c_custkey"), 6).alias("k"))
    return R.multi_get(events_log(spark, d), wanted)


@query(f"WITH {_EV} SELECT c_custkey, k FROM (SELECT c_custkey, 'user/' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS k FROM customer) WHERE k IN (SELECT k FROM {_live('ev')})")
def member_semi(spark, d):
    probes = table(spark, d, "customer").select("c_custkey", K.padded("user/", F.col("c_custkey"), 6).alias("k"))
    return R.members(probes, events_log(spark, d)).select("c_custkey", "k")


@query(f"WITH {_EV} SELECT c_custkey, k FROM (SELECT c_custkey, 'user/' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS k FROM customer) WHERE k NOT IN (SELECT k FROM {_live('ev')})")
def member_anti(spark, d):
    probes = table(spark, d, "customer").select("c_custkey", K.padded("user/", F.col("c_custkey"), 6).alias("k"))
    return R.members(probes, events_log(spark, d), present=False).select("c_custkey", "k")


@query(f"WITH {_EV} SELECT * FROM {_live('ev')} WHERE k >= 'user/000020' AND k < 'user/000090'")
def range_half_open(spark, d):
    return R.range_(events_log(spark, d), "user/000020", "user/000090")


@query(f"WITH {_EV} SELECT * FROM {_live('ev')} WHERE k >= 'user/000100'")
def range_unbounded(spark, d):
    return R.range_(events_log(spark, d), "user/000100", None)


@query(f"WITH {_EV} SELECT * FROM {_live('ev')} WHERE FALSE")
def range_empty(spark, d):
    return R.range_(events_log(spark, d), "user/000100", "user/000100")


@query(f"WITH {_EV} SELECT * FROM {_live('ev', f'seq <= {_CUT}')} WHERE k >= 'user/000020' AND k < 'user/000090'")
def range_at_snapshot(spark, d):
    return R.range_(events_log(spark, d), "user/000020", "user/000090", _CUT)


@query(f"WITH {_LI} SELECT * FROM {_live('li')} WHERE starts_with(k, 'order/00000001')")
def prefix_scan(spark, d):
    return R.prefix(lines_log(spark, d), "order/00000001")


@query(f"WITH {_LI} SELECT k, upper(v) AS v FROM {_live('li')} WHERE starts_with(k, 'order/000000') ORDER BY k LIMIT 25")
def prefix_limit_map(spark, d):
    return R.first_values(R.prefix(lines_log(spark, d), "order/000000"), 25, F.upper)


@query(f"WITH {_EV} SELECT k, v || '!' AS v FROM {_live('ev')} WHERE k >= 'user/000050' ORDER BY k LIMIT 17")
def range_limit_map(spark, d):
    return R.first_values(R.range_(events_log(spark, d), "user/000050"), 17, lambda v: F.concat(v, F.lit("!")))


@query(f"WITH {_EV} SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS pos, k, seq, v FROM {_live('ev')} ORDER BY k LIMIT 50")
def first_of_scan(spark, d):
    top = R.scan(events_log(spark, d)).limit(50)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("k"))).select("pos", "k", "seq", "v")


@query(f"WITH {_CV}, l AS (SELECT *, substr(k, 1, 14) AS prefix FROM {_live('cv')}) SELECT prefix, CAST(rank AS INTEGER) AS rank, k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY k) AS rank FROM l) WHERE rank <= 3")
def latest_k_per_prefix(spark, d):
    return R.first_k_per_prefix(turns_log(spark, d).drop("conv_id"), F.substring("k", 1, 14), 3)


@query(f"WITH {_CV} SELECT k, seq, v FROM {_live('cv')} WHERE starts_with(k, 'conv/00000003/') ORDER BY k LIMIT 2")
def latest_k_of_one(spark, d):
    return R.prefix(turns_log(spark, d).drop("conv_id"), "conv/00000003/").limit(2)


@query(f"WITH {_EV} SELECT k, seq, v FROM {_live('ev')} ORDER BY k DESC LIMIT 20")
def reverse_scan(spark, d):
    return V.live(events_log(spark, d)).select("k", "seq", "v").orderBy(F.desc("k")).limit(20)


# Compaction -----------------------------------------------------------------------------------


@query(f"WITH {_EV} SELECT k, seq, kind FROM {_newest('ev')}")
def hidden_dropped(spark, d):
    return V.compacted(events_log(spark, d)).select("k", "seq", "kind")


@query(f"WITH {_EV}, t AS (SELECT *, max(seq) FILTER (seq <= {_CUT}) OVER (PARTITION BY k) AS top FROM ev) SELECT k, seq, kind FROM t WHERE seq >= coalesce(top, seq)")
def hidden_dropped_at(spark, d):
    return V.compacted(events_log(spark, d), _CUT).select("k", "seq", "kind")


@query(f"WITH {_EV} SELECT k, seq, v FROM {_live('ev')}")
def tombstone_gc(spark, d):
    return V.compacted(events_log(spark, d), drop_deletes=True).select("k", "seq", "v")


@query(f"WITH {_EV} SELECT * FROM {_live('ev')}")
def compacted_equals_live(spark, d):
    log = events_log(spark, d)
    return V.live(V.merged(V.compacted(log.where(F.col("seq") <= _CUT)), log.where(F.col("seq") > _CUT))).select("k", "seq", "v")


_RUNS = f"{_EV}, r AS (SELECT *, CAST(floor((seq - 1) / 1000) AS BIGINT) AS run FROM ev), z AS (SELECT run, min(k) AS min_k, max(k) AS max_k, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS rows, CAST(count(*) FILTER (kind = 2) AS BIGINT) AS tombstones FROM r GROUP BY run)"


@query(f"WITH {_RUNS} SELECT * FROM z")
def run_zone_map(spark, d):
    return S.zone_map(runs_of(events_log(spark, d), 1000))


# Files: orders by priority as levels 0 to 4, by ranges of order keys that grow with the level; level 0 is dealt over 8 files.
_FILES = """o AS (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS level FROM orders),
n AS (SELECT *, CASE WHEN level = 0 THEN o_orderkey % 8 ELSE level * CAST(1000000000 AS BIGINT) + o_orderkey // (4 << level) END AS number FROM o),
f AS (SELECT level, CAST(number AS BIGINT) AS number, min(o_orderkey) AS min_k, max(o_orderkey) AS max_k, CAST(sum(floor(o_totalprice)) AS BIGINT) AS bytes, count(*) AS rows FROM n GROUP BY level, number)"""


def _files(spark, d):
    """All orders as files: a level, a number, a key range and a size each."""
    level = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", level.alias("level"))
    number = F.when(F.col("level") == 0, F.col("o_orderkey") % 8).otherwise(F.col("level") * F.lit(1000000000).cast("long") + F.expr("o_orderkey div shiftleft(4, level)"))
    return o.withColumn("number", number.cast("long")).groupBy("level", "number").agg(F.min("o_orderkey").alias("min_k"), F.max("o_orderkey").alias("max_k"), F.sum(F.floor("o_totalprice").cast("long")).alias("bytes"), F.count("*").alias("rows"))


@query(f"WITH {_FILES} SELECT level, count(*) AS tables, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(rows) AS BIGINT) AS rows FROM f GROUP BY level")
def level_stats(spark, d):
    return S.level_stats(_files(spark, d))


@query(f"WITH {_FILES} SELECT a.number AS a_number, a.min_k AS a_min_k, a.max_k AS a_max_k, b.number AS b_number, b.min_k AS b_min_k, b.max_k AS b_max_k FROM f a JOIN f b ON a.min_k <= b.max_k AND a.max_k >= b.min_k WHERE a.level = 1 AND b.level = 2")
def range_overlaps(spark, d):
    f = _files(spark, d)
    return S.overlapping(f.where("level = 1"), f.where("level = 2"))


@query(f"WITH {_FILES} SELECT number, bytes FROM f a WHERE level = 1 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.level = 2 AND a.min_k <= b.max_k AND a.max_k >= b.min_k) ORDER BY bytes DESC, number LIMIT 8")
def free_runs(spark, d):
    f = _files(spark, d)
    return S.free_runs(f.where("level = 1"), f.where("level = 2")).select("number", "bytes")


@query("WITH f AS (SELECT CAST(1 + o_custkey % 4 AS INTEGER) AS level, CAST(o_custkey AS BIGINT) AS number, min(o_orderkey) AS min_k, max(o_orderkey) AS max_k FROM orders GROUP BY o_custkey) SELECT level, number, before FROM (SELECT *, lag(max_k) OVER (PARTITION BY level ORDER BY min_k, number) AS before FROM f) WHERE before >= min_k")
def level_overlap(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("min_k"), F.max("o_orderkey").alias("max_k"))
    f = o.select((1 + F.col("o_custkey") % 4).cast("int").alias("level"), F.col("o_custkey").cast("long").alias("number"), "min_k", "max_k")
    return S.level_overlaps(f).select("level", "number", "before")


@query(f"WITH {_FILES}, l AS (SELECT level, CAST(sum(bytes) AS DOUBLE) AS bytes, 100000.0 * power(10.0, level - 1) AS budget FROM f WHERE level >= 1 GROUP BY level) SELECT round(sum(greatest(bytes - budget, 0)), 3) AS debt_bytes, round(max(bytes / budget), 6) AS max_ratio, CAST(count(*) FILTER (bytes > budget) AS BIGINT) AS levels_over FROM l")
def debt_by_level(spark, d):
    x = S.debt(S.level_stats(_files(spark, d)), 100_000, 10)
    return x.select(F.round("debt_bytes", 3).alias("debt_bytes"), F.round("max_ratio", 6).alias("max_ratio"), "levels_over")


@query(f"WITH {_FILES} SELECT level, max_by(number, bytes) AS largest, min(number) AS oldest, max(number) AS newest FROM f GROUP BY level")
def oldest_and_newest_run(spark, d):
    return _files(spark, d).groupBy("level").agg(F.max_by("number", "bytes").alias("largest"), F.min("number").alias("oldest"), F.max("number").alias("newest"))


@query(f"WITH {_FILES}, a AS (SELECT level, max(number) AS newest FROM f GROUP BY level), s AS (SELECT number, round((0.5 * least(bytes / 5000000.0, 1.0) + 0.01 * ln(1 + newest - number)) / sqrt(greatest(bytes, 1)), 12) AS score FROM f JOIN a ON a.level = f.level) SELECT number, score FROM s ORDER BY score DESC, number LIMIT 1")
def top_scored(spark, d):
    return S.top_by_score(_files(spark, d), 5_000_000.0)


@query("SELECT DISTINCT o_custkey AS number FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def obsolete_files(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("number")).distinct().join(o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("number")).distinct(), "number", "left_anti")


# Totals ---------------------------------------------------------------------------------------


@query(f"WITH {_LI} SELECT count(*) AS live_keys, CAST(sum(length(k) + length(v)) AS BIGINT) AS live_bytes FROM {_live('li')}")
def integrity_totals(spark, d):
    return S.integrity_totals(V.live(lines_log(spark, d)))


@query(f"WITH {_LI}, t AS (SELECT length(k) + coalesce(length(v), 0) + 32 AS s, row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1 AS top FROM li) SELECT CAST(sum(s) AS BIGINT) AS all_bytes, CAST(sum(s) FILTER (top) AS BIGINT) AS newest_bytes FROM t")
def logical_bytes(spark, d):
    return S.logical_bytes(lines_log(spark, d))


@query("SELECT l_returnflag AS run, round(sum(l_extendedprice) / sum(l_quantity), 6) AS amplification FROM lineitem GROUP BY l_returnflag")
def write_amp(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(F.sum("l_extendedprice").alias("w"), F.sum("l_quantity").alias("a"))
    return x.select("run", F.round(S.write_amplification(F.col("w"), F.col("a")), 6).alias("amplification"))


@query(f"WITH {_EV} SELECT count(DISTINCT k) AS n FROM ev")
def distinct_keys(spark, d):
    return events_log(spark, d).agg(F.count_distinct("k").alias("n"))


# Measurements ---------------------------------------------------------------------------------

_NS = "n AS (SELECT l_linenumber AS op, CAST(round(l_extendedprice * 100) AS BIGINT) AS ns FROM lineitem)"
_BUCKET = "CASE WHEN ns < 32 THEN ns ELSE (length(bin(ns)) - 5) * 32 + (ns >> (length(bin(ns)) - 6)) - 32 END"
_TOP = "CASE WHEN b < 32 THEN b ELSE ((32 + b % 32 + 1) << CAST(b // 32 - 1 AS INTEGER)) - 1 END"


def _latencies(spark, d):
    """Prices as latencies of an operation for each ship mode."""
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("op"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("ns"))


@query(f"WITH {_NS} SELECT op, CAST({_BUCKET} AS BIGINT) AS bucket, count(*) AS n FROM n GROUP BY ALL")
def latency_histogram(spark, d):
    return M.histogram(_latencies(spark, d), ["op"])


@query(f"WITH {_NS}, h AS (SELECT op, CAST({_BUCKET} AS BIGINT) AS b, count(*) AS c FROM n GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY op) AS total, sum(c) OVER (PARTITION BY op ORDER BY b) AS upto, {_TOP} AS top FROM h) SELECT op, CAST(max(total) AS BIGINT) AS total, CAST(min(top) FILTER (upto >= greatest(ceil(total * 0.5), 1)) AS BIGINT) AS p50, CAST(min(top) FILTER (upto >= greatest(ceil(total * 0.95), 1)) AS BIGINT) AS p95, CAST(min(top) FILTER (upto >= greatest(ceil(total * 0.99), 1)) AS BIGINT) AS p99, CASE WHEN max(total) >= 10000 THEN CAST(min(top) FILTER (upto >= greatest(ceil(total * 0.999), 1)) AS BIGINT) END AS p999 FROM r GROUP BY op")
def hist_percentile(spark, d):
    halves = _latencies(spark, d).withColumn("half", F.pmod("ns", F.lit(2)))
    parts = M.histogram(halves, ["op", "half"])
    return M.histogram_percentiles(M.merged_histograms(parts, ["op"]), ["op"])


@query(f"WITH {_NS}, r AS (SELECT op, ns, row_number() OVER (PARTITION BY op ORDER BY ns) AS r, count(*) OVER (PARTITION BY op) AS c FROM n) SELECT op, max(ns) FILTER (r = least(floor(c * 0.5) + 1, c)) AS p50, max(ns) FILTER (r = least(floor(c * 0.95) + 1, c)) AS p95, max(ns) FILTER (r = least(floor(c * 0.99) + 1, c)) AS p99 FROM r GROUP BY op")
def exact_percentile(spark, d):
    return M.exact_percentiles(_latencies(spark, d), ["op"])


@query("SELECT l_linenumber AS op, round(median(l_quantity), 6) AS median, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def group_spread(spark, d):
    x = M.group_spread(table(spark, d, "lineitem").withColumn("op", F.col("l_linenumber")), ["op"], "l_quantity")
    return x.withColumn("median", F.round("median", 6))


@query("WITH t AS (SELECT l_suppkey AS pair, l_linenumber AS op, avg(l_quantity) FILTER (l_returnflag = 'A') AS a, avg(l_quantity) FILTER (l_returnflag = 'N') AS b FROM lineitem GROUP BY ALL), r AS (SELECT op, a / b AS ratio FROM t WHERE a IS NOT NULL AND b <> 0) SELECT op, round(median(ratio), 6) AS median, round(min(ratio), 6) AS least, round(max(ratio), 6) AS most, count(*) AS n FROM r GROUP BY op")
def paired_ratio(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pair"), F.col("l_linenumber").alias("op"), "l_returnflag", F.col("l_quantity").alias("x"))
    x = M.paired_ratio(t, ["pair", "op"], "l_returnflag", "A", "N", "x", ["op"])
    return x.select("op", *[F.round(c, 6).alias(c) for c in ("median", "least", "most")], "n")


@query("SELECT l_linenumber AS op, round(exp(avg(ln(l_extendedprice))), 3) AS geomean FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_linenumber")
def geomean(spark, d):
    x = M.geometric_mean(table(spark, d, "lineitem").withColumn("op", F.col("l_linenumber")), ["op"], "l_extendedprice")
    return x.select("op", F.round("geomean", 3).alias("geomean"))


@query("WITH t AS (SELECT event_type AS op, value, ntile(3) OVER (PARTITION BY event_type ORDER BY event_id) AS t FROM events), r AS (SELECT op, sum(value) FILTER (t = 1) / count(*) FILTER (t = 1) AS a, sum(value) FILTER (t = 3) / count(*) FILTER (t = 3) AS b FROM t GROUP BY op) SELECT op, round(a, 5) AS first_rate, round(b, 5) AS last_rate, round((b / a - 1) * 100, 4) AS change_percent FROM r")
def thirds_rate(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("op"), "event_id", "value", F.lit(1).alias("s"))
    x = M.third_rates(e, ["op"], "event_id", "value", "s")
    return x.select("op", F.round("first_rate", 5).alias("first_rate"), F.round("last_rate", 5).alias("last_rate"), F.round("change_percent", 4).alias("change_percent"))


@query("SELECT event_type AS op, max(value) AS peak FROM events GROUP BY event_type")
def peak_value(spark, d):
    return M.peak(table(spark, d, "events").withColumn("op", F.col("event_type")), ["op"], "value")


@query('SELECT event_type AS op, event_id // 500 AS "window", round(median(value), 6) AS median FROM events GROUP BY ALL')
def window_median(spark, d):
    x = M.window_medians(table(spark, d, "events").withColumn("op", F.col("event_type")), ["op"], "event_id", 500, "value")
    return x.withColumn("median", F.round("median", 6))


@query("SELECT user_id, event_id, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 0) AS gap_before FROM events")
def trace_gaps(spark, d):
    return M.gaps(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("WITH c AS (SELECT user_id, event_id, count(*) FILTER (event_type = 'view') OVER w AS up, count(*) FILTER (event_type = 'click') OVER w AS down FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), d AS (SELECT *, up - coalesce(lag(up) OVER w, 0) AS du, down - coalesce(lag(down) OVER w, 0) AS dd FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, coalesce(last_value(CASE WHEN dd > 0 THEN CAST(du AS DOUBLE) / dd END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0.0) AS per_unit FROM d")
def probe_delta(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    c = table(spark, d, "events").select("user_id", "event_id", F.count_if(F.col("event_type") == "view").over(w).alias("up"), F.count_if(F.col("event_type") == "click").over(w).alias("down"))
    return M.rate_of_change(c, ["user_id"], "event_id", "up", "down").select("user_id", "event_id", "per_unit")


@query("WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), f AS (SELECT user_id, CAST(0.0 AS DOUBLE) AS e, CAST(0 AS BIGINT) AS i FROM (SELECT DISTINCT user_id FROM s) UNION ALL SELECT f.user_id, 0.3 * CAST(s.value AS DOUBLE) + 0.7 * f.e, s.i FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1) SELECT f.user_id, round(f.e, 6) AS ewma FROM f JOIN (SELECT DISTINCT user_id, n FROM s) t ON t.user_id = f.user_id AND t.n = f.i")
def ewma(spark, d):
    return M.smoothed(table(spark, d, "events"), ["user_id"], "event_id", "value").select("user_id", F.round("ewma", 6).alias("ewma"))


@query("WITH t AS (SELECT user_id, event_type AS mode, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS d FROM events) SELECT user_id, mode, CAST(sum(d) AS BIGINT) AS time FROM t GROUP BY ALL")
def mode_times(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("mode"))
    return M.mode_times(e, ["user_id"], "event_id", "mode")


@query("WITH t AS (SELECT user_id, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) SELECT user_id, CAST(count(*) FILTER (s) AS BIGINT) AS switches FROM t GROUP BY user_id")
def mode_switches(spark, d):
    return M.mode_switches(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query("SELECT l_linenumber AS op, round(avg(abs(l_extendedprice - l_quantity * 1500) / greatest(l_quantity * 1500, 1)), 8) AS error, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def pred_error(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("op"), (F.col("l_quantity") * 1500).alias("p"), F.col("l_extendedprice").alias("a"))
    return M.prediction_error(x, ["op"], "p", "a").select("op", F.round("error", 8).alias("error"), "n")


# Keys and values ------------------------------------------------------------------------------


@query("SELECT o_orderkey, lpad(printf('%X', o_orderkey), 16, '0') AS big_endian, 'user' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS padded, lpad(CAST(18446744073709551615 - CAST(o_orderkey AS HUGEINT) AS VARCHAR), 20, '0') AS newest_first FROM orders")
def key_encoders(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.hex(K.u64_key_of(F.col("o_orderkey"))).alias("big_endian"), K.padded("user", F.col("o_custkey"), 10).alias("padded"), K.descending_text(F.col("o_orderkey")).alias("newest_first"))


def _memories(spark, d):
    c = table(spark, d, "conversations")
    return c.select(K.padded("agent/", F.col("conv_id") % 64, 4).alias("agent"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.to_json(F.struct("role", F.length("text").alias("size"))).alias("v"))


@query("SELECT 'agent/' || lpad(CAST(conv_id % 64 AS VARCHAR), 4, '0') AS agent, conv_id * 100 + turn AS id, role, CAST(length(text) AS INTEGER) AS size FROM conversations WHERE conv_id * 100 + turn IN (0, 101, 202, 303, 1202)")
def recall_by_id(spark, d):
    m = _memories(spark, d).where(F.col("id").isin(0, 101, 202, 303, 1202))
    return m.select("agent", "id", F.from_json("v", "role string, size int").alias("j")).select("agent", "id", "j.role", "j.size")


@query("WITH m AS (SELECT 'agent/' || lpad(CAST(conv_id % 64 AS VARCHAR), 4, '0') AS agent, conv_id * 100 + turn AS id, role FROM conversations) SELECT agent, CAST(rank AS INTEGER) AS rank, id, role FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY id DESC) AS rank FROM m) WHERE rank <= 10")
def recent_for_agent(spark, d):
    m = _memories(spark, d).withColumn("k", F.concat("agent", F.lit("/memory/"), K.descending_text(F.col("id")))).withColumn("rank", F.row_number().over(Window.partitionBy("agent").orderBy("k"))).where("rank <= 10")
    return m.select("agent", "rank", "id", F.get_json_object("v", "$.role").alias("role"))


@query(f"WITH {_EV}, b AS (SELECT k, 1000000 + seq AS seq, CASE WHEN seq % 10 = 0 THEN 2 ELSE 1 END AS kind, v || '+' AS v FROM ev WHERE seq % 5 = 0), u AS (SELECT * FROM ev UNION ALL SELECT * FROM b) SELECT v, count(*) AS keys FROM {_live('u')} GROUP BY v")
def mixed_apply(spark, d):
    log = events_log(spark, d)
    more = log.where("seq % 5 = 0").select("k", (F.lit(1000000) + F.col("seq")).alias("seq"), F.when(F.col("seq") % 10 == 0, 2).otherwise(1).alias("kind"), F.concat("v", F.lit("+")).alias("v"))
    return V.live(V.merged(log, more)).groupBy("v").agg(F.count("*").alias("keys"))


@query("SELECT doc_id, strlen(text) AS bytes, TRUE AS valid FROM documents")
def value_checksums(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.is_valid_utf8("text").alias("valid"))


@query("WITH b AS (SELECT k, v FROM (SELECT c_mktsegment AS k, c_custkey AS v FROM customer)) SELECT k, CAST(max(v) AS BIGINT) AS v, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY k")
def last_op_wins(spark, d):
    c = table(spark, d, "customer")
    batch = c.select(F.lit("put").alias("op"), F.col("c_mktsegment").alias("k"), F.col("c_custkey").cast("string").alias("v"), F.col("c_custkey").alias("ord"))
    log = B.sequenced(batch, 0)
    n = log.groupBy("k").agg(F.count("*").alias("n"))
    return V.live(log).join(n, "k").select("k", F.col("v").cast("long").alias("v"), "n")


@query("SELECT o_orderkey AS ord, CASE WHEN o_orderstatus = 'P' THEN 'unknown operation' WHEN o_orderpriority LIKE '1%' THEN 'put without value' END AS reason FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority LIKE '1%'")
def batch_faults(spark, d):
    o = table(spark, d, "orders")
    batch = o.select(F.when(F.col("o_orderstatus") == "P", "merge").otherwise("put").alias("op"), F.col("o_orderkey").cast("string").cast("binary").alias("k"), F.when(~F.col("o_orderpriority").startswith("1"), F.lit("x")).cast("binary").alias("v"), F.col("o_orderkey").alias("ord"))
    return B.faults(batch).select("ord", "reason")


# Stores ---------------------------------------------------------------------------------------

QUERIES |= store_queries.QUERIES
ORACLE_SQL |= store_queries.ORACLE_SQL
