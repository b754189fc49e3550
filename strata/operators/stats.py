"""Statistics of a store's runs and of a log, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes counted for each entry besides key and value. Fixed value.
ENTRY_BYTES = 32


def level_budget(level: Column, base: int, multiplier: int) -> Column:
    """base * multiplier^(level - 1); none for level 0."""
    return F.when(level >= 1, F.lit(base) * F.pow(F.lit(float(multiplier)), level - 1)).cast("double")


def level_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level").agg(F.count("*").alias("tables"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


def zone_map(log: DataFrame, run: str = "run") -> DataFrame:
    """Bounds of keys and sequence numbers of each run."""
    return log.groupBy(run).agg(F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("rows"), F.sum((F.col("kind") == 2).cast("long")).alias("tombstones"))


def _in_buckets(runs: DataFrame, low: str, high: str, bounds: list) -> DataFrame:
    """Each run once for every bucket of keys that its range meets; ``bounds`` are where buckets after the first begin."""

    def bucket(key: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(key))) if bounds else F.lit(0)

    at = bucket(low), bucket(high)
    return runs.withColumn("_first", at[0]).withColumn("_bucket", F.explode(F.sequence(F.col("_first"), at[1])))


def key_bounds(runs: DataFrame, buckets: int = 256, sample: int = 8192) -> list:
    """Ascending keys that cut the runs into about equal buckets, from a bounded sample; they decide balance only."""
    keys = runs.select("min_k").where(F.col("min_k").isNotNull()).orderBy(F.xxhash64("min_k")).limit(sample)
    seen = sorted(r[0] for r in keys.collect())
    n = min(buckets, len(seen) // 16 + 1)
    return sorted({seen[i * len(seen) // n] for i in range(1, n)})


def _met(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Runs a_* and b_* whose ranges meet, joined by bucket; a pair counts in the bucket where the later of the two begins."""
    bounds = key_bounds(b)
    x, y = _in_buckets(a, "a_min_k", "a_max_k", bounds), _in_buckets(b.select(*[F.col(c).alias(f"b_{c}") for c in ("number", "min_k", "max_k")]), "b_min_k", "b_max_k", bounds)
    x, y = x.withColumnRenamed("_first", "_a"), y.withColumnRenamed("_first", "_b").withColumnRenamed("_bucket", "_other")
    return x.join(y, (F.col("_bucket") == F.col("_other")) & (F.col("a_min_k") <= F.col("b_max_k")) & (F.col("a_max_k") >= F.col("b_min_k")) & (F.col("_bucket") == F.greatest("_a", "_b")), how)


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of runs of two levels whose key ranges meet: an equi-join of buckets of keys, each pair once."""
    x = a.select(*[F.col(c).alias(f"a_{c}") for c in ("number", "min_k", "max_k")])
    return _met(x, b, "inner").select(*[f"{s}_{c}" for s in "ab" for c in ("number", "min_k", "max_k")])


def free_runs(level: DataFrame, below: DataFrame, most: int = 8) -> DataFrame:
    """Runs that meet none of the next level, the largest first."""
    x = level.select(*[F.col(c).alias(f"a_{c}") for c in ("number", "min_k", "max_k")])
    busy = _met(x, below, "left_semi").select(F.col("a_number").alias("number")).distinct()
    return level.join(busy, "number", "left_anti").select(*level.columns).orderBy(F.desc("bytes"), "number").limit(most)


def level_overlaps(runs: DataFrame) -> DataFrame:
    """Neighbours within a level from 1 on that overlap; none in a sound store."""
    before = F.lag("max_k").over(Window.partitionBy("level").orderBy("min_k", "number"))
    return runs.where("level >= 1").withColumn("before", before).where(F.col("before") >= F.col("min_k"))


def top_by_score(runs: DataFrame, full: float) -> DataFrame:
    """The run with the best benefit for the square root of its bytes: fullness and age, which is the distance to its level's newest number."""
    newest = runs.groupBy("level").agg(F.max("number").alias("newest"))
    benefit = 0.5 * F.least(F.col("bytes") / full, F.lit(1.0)) + 0.01 * F.log1p(F.col("newest") - F.col("number"))
    scored = runs.join(newest, "level").select("number", F.round(benefit / F.sqrt(F.greatest("bytes", F.lit(1))), 12).alias("score"))
    return scored.orderBy(F.desc("score"), "number").limit(1)


def debt(levels: DataFrame, base: int, multiplier: int) -> DataFrame:
    """Bytes over budget in all, the largest ratio to a budget, and how many levels are over."""
    x = levels.where("level >= 1").withColumn("budget", level_budget(F.col("level"), base, multiplier))
    return x.agg(F.coalesce(F.sum(F.greatest(F.col("bytes") - F.col("budget"), F.lit(0.0))), F.lit(0.0)).alias("debt_bytes"), F.coalesce(F.max(F.col("bytes") / F.col("budget")), F.lit(0.0)).alias("max_ratio"), F.count_if(F.col("bytes") > F.col("budget")).alias("levels_over"))


def logical_bytes(log: DataFrame) -> DataFrame:
    """Keys, values and a fixed share of each entry: of all versions and of the newest."""
    size = F.length("k") + F.coalesce(F.length("v"), F.lit(0)) + ENTRY_BYTES
    top = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("seq"))) == 1
    return log.withColumn("_s", size.cast("long")).withColumn("_t", top).agg(F.sum("_s").alias("all_bytes"), F.sum(F.when(F.col("_t"), F.col("_s"))).alias("newest_bytes"))


def integrity_totals(live: DataFrame) -> DataFrame:
    return live.agg(F.count("*").alias("live_keys"), F.coalesce(F.sum(F.length("k") + F.length("v")), F.lit(0)).cast("long").alias("live_bytes"))


def write_amplification(written: Column, asked: Column) -> Column:
    return F.when(asked > 0, written / asked)


def average_batch(operations: Column) -> Column:
    """Operations of a batch on average; null without batches."""
    return F.avg(operations)
