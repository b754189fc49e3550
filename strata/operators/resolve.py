"""Resolution of a change log: which version of a key counts.

Only sequence numbers decide; the order of files or rows never does. A bound on sequence numbers goes
below the resolution and filters on values go above it. Filters on the key pass through the window into the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.schema import DELETE, PUT


def newest(log: DataFrame, at: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """The newest version of each key with a sequence number up to ``at``; deletions are kept.

    A rank of 1 is cut before the shuffle as well, so each task sends a row a key at most.
    """
    keys = keys or ["k"]
    rows = log if at is None else log.where(F.col("seq") <= at)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def live(log: DataFrame, at: int | None = None) -> DataFrame:
    """Keys that are not deleted, with their newest version."""
    return newest(log, at).where(F.col("kind") == PUT)


def live_keys(log: DataFrame, at: int | None = None) -> DataFrame:
    """k and seq only, so values are not read; a partial aggregate suffices."""
    rows = log if at is None else log.where(F.col("seq") <= at)
    top = rows.groupBy("k").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"))
    return top.where(F.col("kind") == PUT).select("k", "seq")


def history(log: DataFrame, key) -> DataFrame:
    """All versions of a key, newest first."""
    return log.where(F.col("k") == F.lit(key)).orderBy(F.desc("seq"))


def merged(*logs: DataFrame) -> DataFrame:
    """All versions of all sources."""
    return reduce(DataFrame.unionByName, logs)


def merge_ordered(*logs: DataFrame) -> DataFrame:
    """All versions in the order of keys, newest first within a key."""
    return merged(*logs).orderBy("k", F.desc("seq"))


def as_of(probes: DataFrame, log: DataFrame, on: str = "k", at: str = "at_seq") -> DataFrame:
    """Each probe (columns ``on`` and ``at``) with the version of its key that was newest at ``at``.

    Probe and log are sorted once by key and sequence number; the last version runs along. No row is
    multiplied by versions. Adds found (false if none or deleted), seq and v.
    """
    tag = F.struct("kind", "v", "seq")
    left = probes.select(F.col(on).alias("k"), F.col(at).alias("_at"), F.lit(1).alias("_probe"), F.lit(None).cast(log.select(tag.alias("t")).schema["t"].dataType).alias("_t"), F.struct(*probes.columns).alias("_row"))
    right = log.select("k", F.col("seq").alias("_at"), F.lit(0).alias("_probe"), tag.alias("_t"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("k").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    run = left.unionByName(right).withColumn("_t", F.last("_t", ignorenulls=True).over(w)).where("_probe = 1")
    found = F.coalesce(F.col("_t.kind") == PUT, F.lit(False))
    return run.select("_row.*", found.alias("found"), F.when(found, F.col("_t.seq")).alias("seq"), F.when(found, F.col("_t.v")).alias("v"))


def retained(log: DataFrame, low: int | None, high: int | None = None) -> DataFrame:
    """Versions that a snapshot from ``low`` on may need: those over low, and the newest up to low."""
    if low is None:
        return newest(log)
    rows = log if high is None else log.where(F.col("seq") <= high)
    old = newest(rows.where(F.col("seq") <= low))
    return rows.where(F.col("seq") > low).unionByName(old)


def compacted(log: DataFrame, visible: int | None = None, drop_deletes: bool = False) -> DataFrame:
    """What a rewrite keeps: versions not hidden by a newer one up to ``visible``, and deletions unless
    nothing below can hold their key."""
    newer = F.max(F.when(F.col("seq") <= visible, F.col("seq")) if visible is not None else F.col("seq")).over(Window.partitionBy("k"))
    rows = log.withColumn("_top", newer).where((F.col("seq") >= F.coalesce("_top", "seq"))).drop("_top")
    return rows.where(F.col("kind") != DELETE) if drop_deletes else rows


def applied(log: DataFrame, batch: DataFrame, base: int) -> DataFrame:
    """log and a batch (op, k, v, ord) with sequence numbers that follow ``base`` in the order of ord."""
    from strata.operators.batch import sequenced

    return log.unionByName(sequenced(batch, base))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose live value differs: k, before, after and change (added, removed, changed)."""
    x, y = a.select("k", F.col("v").alias("before"), F.lit(True).alias("_a")), b.select("k", F.col("v").alias("after"), F.lit(True).alias("_b"))
    both = x.join(y, "k", "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select("k", "before", "after", "change")
