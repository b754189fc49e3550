"""Reads of a resolved log: points, ranges, prefixes, first K of each prefix, membership."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.keys import has_prefix, in_range
from strata.operators.resolve import live
from strata.schema import InvalidArgument

#: Requested keys up to this count are broadcast; more are joined by a shuffle.
FEW_KEYS = 1_000_000


def get(log: DataFrame, key, at: int | None = None) -> DataFrame:
    """No row, or one: k, seq, v."""
    return live(log.where(F.col("k") == F.lit(key)), at).select("k", "seq", "v")


def scan(log: DataFrame, at: int | None = None) -> DataFrame:
    """All live rows in key order."""
    return live(log, at).select("k", "seq", "v").orderBy("k")


def range_(log: DataFrame, start=None, end=None, at: int | None = None) -> DataFrame:
    """Live rows with start <= k < end in key order; None is unbounded."""
    return live(log.where(in_range(F.col("k"), start, end)), at).select("k", "seq", "v").orderBy("k")


def prefix(log: DataFrame, p, at: int | None = None) -> DataFrame:
    """Live rows whose key starts with p, in key order."""
    return live(log.where(has_prefix(F.col("k"), p)), at).select("k", "seq", "v").orderBy("k")


def first_values(rows: DataFrame, count: int, value: Column | Callable[[Column], Column] | None = None) -> DataFrame:
    """The first ``count`` of rows in key order, with a mapping of the value; the limit counts live rows."""
    if count < 0:
        raise InvalidArgument("count is negative")
    v = F.col("v") if value is None else value(F.col("v")) if callable(value) else value
    return rows.orderBy("k").limit(count).select("k", v.alias("v"))


def first_k_per_prefix(log: DataFrame, group: Column, k: int, at: int | None = None) -> DataFrame:
    """The first k live rows of each group in key order, with their rank.

    The rank limit is cut before the shuffle too.
    """
    rows = live(log, at).withColumn("prefix", group)
    w = Window.partitionBy("prefix").orderBy("k")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("prefix", "rank", "k", "seq", "v")


def _sent(keys: DataFrame) -> DataFrame:
    """The keys, marked for broadcast if few; the count is checked, not assumed."""
    return F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys


def multi_get(log: DataFrame, keys: DataFrame, at: int | None = None) -> DataFrame:
    """Every requested key once: k, found, seq, v."""
    wanted = keys.select("k").where(F.col("k").isNotNull()).distinct()
    hits = live(log.join(_sent(wanted), "k", "left_semi"), at).select("k", "seq", "v", F.lit(True).alias("_hit"))
    return wanted.join(hits, "k", "left").select("k", F.coalesce("_hit", F.lit(False)).alias("found"), "seq", "v")


def members(probes: DataFrame, log: DataFrame, present: bool = True, at: int | None = None) -> DataFrame:
    """Probe rows whose key is live, or not."""
    return probes.join(live(log, at).select("k"), "k", "left_semi" if present else "left_anti")
