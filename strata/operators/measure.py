"""Measurements: latency histograms, percentiles, paired ratios, trends, folds over series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-buckets of each power of two, and the least count for a p99.9. Fixed values.
SUB_BUCKETS = 32
LEAST_FOR_P999 = 10_000


def bucket(ns: Column) -> Column:
    """Bucket of a latency: exact under 32, then 32 buckets for each power of two."""
    x = F.greatest(ns.cast("long"), F.lit(0))
    power = (F.length(F.bin(x)) - 6).cast("int")  # exact, unlike a logarithm
    top = F.call_function("shiftright", x, F.greatest(power, F.lit(0)))
    return F.when(x < SUB_BUCKETS, x).otherwise((power + 1) * SUB_BUCKETS + top - SUB_BUCKETS).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest latency of a bucket."""
    power = F.floor(b / SUB_BUCKETS) - 1
    base = (F.lit(SUB_BUCKETS) + F.pmod(b, F.lit(SUB_BUCKETS)) + 1).cast("double") * F.pow(F.lit(2.0), power)
    return F.when(b < SUB_BUCKETS, b).otherwise(base.cast("long") - 1).cast("long")


def histogram(samples: DataFrame, by: list[str], ns: str = "ns") -> DataFrame:
    """Counts by group and bucket; histograms of parts add up."""
    return samples.withColumn("bucket", bucket(F.col(ns))).groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def merged_histograms(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def histogram_percentiles(counts: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99, 0.999)) -> DataFrame:
    """Upper bounds of percentiles: the top of the first bucket whose running count reaches the rank."""
    w = Window.partitionBy(*by)
    run = counts.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
    columns = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * F.lit(s)), F.lit(1)), bucket_top(F.col("bucket")))).alias(f"p{str(s)[2:].ljust(2, '0')}") for s in shares]
    out = run.groupBy(*by).agg(F.max("total").alias("total"), *columns)
    return out.withColumn("p999", F.when(F.col("total") >= LEAST_FOR_P999, F.col("p999"))) if "p999" in out.columns else out


def exact_percentiles(samples: DataFrame, by: list[str], ns: str = "ns", shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles by rank and group count, without gathering a group."""
    w = Window.partitionBy(*by)
    ranked = samples.withColumn("_r", F.row_number().over(w.orderBy(ns))).withColumn("_n", F.count("*").over(w))
    columns = [F.max(F.when(F.col("_r") == F.least(F.floor(F.col("_n") * F.lit(s)) + 1, F.col("_n")), F.col(ns))).alias(f"p{str(s)[2:].ljust(2, '0')}") for s in shares]
    return ranked.groupBy(*by).agg(*columns)


def group_spread(samples: DataFrame, by: list[str], x: str) -> DataFrame:
    return samples.groupBy(*by).agg(F.expr(f"median({x})").alias("median"), F.min(x).alias("least"), F.max(x).alias("most"), F.count("*").alias("n"))


def paired_ratio(trials: DataFrame, pair: list[str], side: str, a: str, b: str, x: str, by: list[str]) -> DataFrame:
    """Median and range of x(a) / x(b) over trials that have both sides."""
    both = trials.groupBy(*pair).agg(F.avg(F.when(F.col(side) == a, F.col(x))).alias("_a"), F.avg(F.when(F.col(side) == b, F.col(x))).alias("_b"))
    ratio = both.where(F.col("_a").isNotNull() & (F.col("_b") != 0)).withColumn("ratio", F.col("_a") / F.col("_b"))
    return group_spread(ratio, by, "ratio")


def geometric_mean(samples: DataFrame, by: list[str], x: str) -> DataFrame:
    return samples.where(F.col(x) > 0).groupBy(*by).agg(F.exp(F.avg(F.log(x))).alias("geomean"))


def third_rates(samples: DataFrame, by: list[str], at: str, ops: str, seconds: str) -> DataFrame:
    """Operations a second in the first and the last third of a run, and the change in percent."""
    third = F.ntile(3).over(Window.partitionBy(*by).orderBy(at))
    part = lambda n: F.sum(F.when(F.col("_t") == n, F.col(ops))) / F.sum(F.when(F.col("_t") == n, F.col(seconds)))
    out = samples.withColumn("_t", third).groupBy(*by).agg(part(1).alias("first_rate"), part(3).alias("last_rate"))
    return out.withColumn("change_percent", (F.col("last_rate") / F.col("first_rate") - 1) * 100)


def peak(samples: DataFrame, by: list[str], x: str) -> DataFrame:
    return samples.groupBy(*by).agg(F.max(x).alias("peak"))


def window_medians(samples: DataFrame, by: list[str], at: str, width: int, x: str) -> DataFrame:
    """Median of x in windows of ``width`` of a number."""
    return samples.withColumn("window", F.floor(F.col(at) / width).cast("long")).groupBy(*by, "window").agg(F.expr(f"median({x})").alias("median"))


def gaps(trace: DataFrame, by: list[str], seq: str) -> DataFrame:
    """How many numbers are missing before each row of a trace."""
    before = F.lag(seq).over(Window.partitionBy(*by).orderBy(seq))
    return trace.withColumn("gap_before", F.coalesce(F.col(seq) - before - 1, F.lit(0)))


def rate_of_change(counters: DataFrame, by: list[str], at: str, up: str, down: str) -> DataFrame:
    """Change of ``up`` over change of ``down`` since the row before; the last known value where down stands still."""
    w = Window.partitionBy(*by).orderBy(at)
    du, dd = F.col(up) - F.coalesce(F.lag(up).over(w), F.lit(0)), F.col(down) - F.coalesce(F.lag(down).over(w), F.lit(0))
    now = counters.withColumn("_x", F.when(dd > 0, du / dd))
    return now.withColumn("per_unit", F.coalesce(F.last("_x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).drop("_x")


def smoothed(series: DataFrame, by: list[str], at: str, x: str, alpha: float = 0.3) -> DataFrame:
    """Exponentially weighted average of each series at its end: a fold over the series in order.

    For an array of one series' samples; series are bounded traces.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(x).cast("double").alias("x"))))
    return series.groupBy(*by).agg(F.aggregate(ordered, F.lit(0.0), lambda a, s: F.lit(alpha) * s["x"] + F.lit(1 - alpha) * a).alias("ewma"))


def mode_times(trace: DataFrame, by: list[str], at: str, mode: str) -> DataFrame:
    """Time in each mode: from a row to the next one of its trace."""
    w = Window.partitionBy(*by).orderBy(at)
    return trace.withColumn("_d", F.lead(at).over(w) - F.col(at)).groupBy(*by, mode).agg(F.sum("_d").alias("time"))


def mode_switches(trace: DataFrame, by: list[str], at: str, mode: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at)
    return trace.withColumn("_s", (F.col(mode) != F.lag(mode).over(w)).cast("long")).groupBy(*by).agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("switches"))


def prediction_error(pairs: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    """Mean absolute error as a share of the prediction (1 at least)."""
    e = F.abs(F.col(actual) - F.col(predicted)) / F.greatest(F.col(predicted), F.lit(1))
    return pairs.groupBy(*by).agg(F.avg(e).alias("error"), F.count("*").alias("n"))


def bucket_value(ns: int) -> int:
    """The bucket of one latency, for tests and for the driver."""
    if ns < SUB_BUCKETS:
        return max(ns, 0)
    power = ns.bit_length() - 1 - 5
    return (power + 1) * SUB_BUCKETS + (ns >> power) - SUB_BUCKETS
