"""Change logs made from tables: the sources that the catalogue's queries run on."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.keys import padded
from strata.schema import InvalidArgument


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A path of its own in the folder that spark.checkpoint.dir names, which must be one that the driver and all executors mount."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise InvalidArgument("spark.checkpoint.dir is not set")
        named = tempfile.mkdtemp(prefix="strata-")
    where = urlsplit(named)
    if where.scheme not in ("", "file"):
        raise InvalidArgument(f"a store needs a mounted folder, not {named}")
    return f"{where.path}/store-{uuid.uuid4().hex}"


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of a user's key for each event; errors delete."""
    e = table(spark, sf_dir, "events")
    return e.select(padded("user/", F.col("user_id"), 6).alias("k"), (F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("kind"), F.col("event_type").alias("v"))


def lines_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of an order line for each row. Lines repeat, so versions are numbered within the line."""
    x = table(spark, sf_dir, "lineitem")
    k = F.concat(padded("order/", F.col("l_orderkey"), 10), padded("/line/", F.col("l_linenumber"), 2))
    order = Window.partitionBy("k").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return x.withColumn("k", k).withColumn("seq", F.row_number().over(order).cast("long")).select("k", "seq", F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("kind"), F.col("l_linestatus").alias("v"))


def turns_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each turn of a conversation; later turns sort first, as in a newest-first index."""
    c = table(spark, sf_dir, "conversations")
    k = F.concat(padded("conv/", F.col("conv_id"), 8), padded("/", F.lit(9999) - F.col("turn"), 4))
    return c.select(k.alias("k"), (F.col("conv_id") * 10_000 + F.col("turn") + 1).alias("seq"), F.lit(1).alias("kind"), F.concat_ws(":", "role", F.length("text").cast("string")).alias("v"), F.col("conv_id"))


def runs_of(log: DataFrame, size: int) -> DataFrame:
    """The log cut into runs of ``size`` sequence numbers, as flushes of a buffer would."""
    return log.withColumn("run", F.floor((F.col("seq") - 1) / size).cast("long"))
