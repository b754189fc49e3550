"""What the operators share on the driver: the folder that all executors see and hashing of ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of its own only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = getattr(shared_dir, "own", None)
        if own is None:
            own = shared_dir.own = tempfile.mkdtemp(prefix="strata-")
        named = f"file://{own}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


#: Spark's own bound of the bytes sent to a Python worker at once, and the one used here where that stands.
_DEFAULT_BATCH, BATCH = "67108864b", "8m"


def small_batches(spark: SparkSession) -> None:
    """Send a Python worker about 8 MB at once, unless the session has a bound of its own.

    A bound of rows alone lets long texts fill a worker; each operator that sends texts calls this.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(name, BATCH)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows written as a table in the shared folder and read back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def spread(column: str = "doc_id", buckets: int = 1 << 20, seed: int = 11) -> Column:
    """A scrambled bucket of the id; bounded samples are taken by it."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(buckets))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it differ from the columns of df in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def widened(df: DataFrame, more: str) -> StructType:
    """The schema of df with the columns of the schema string after it."""
    return StructType([*df.schema.fields, *_parse_datatype_string(more).fields])
