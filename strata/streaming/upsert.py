"""A stream of operations into a store, and a live view over a change stream. Extensions.

Each micro-batch is one atomic commit. The store's last batch id makes replays after a failure
idempotent: a batch that was committed is not applied again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.resolve import newest
from strata.sources.store import Store

#: The key under which a store keeps the last batch id of a stream.
MARK = b"\x00stream/"


def into_store(ops: DataFrame, store: Store, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream (op, k, v, ord) to a store."""
    mark = MARK + name.encode()

    def apply(batch: DataFrame, number: int) -> None:
        done = store.get(mark)
        if done is not None and int(done) >= number:
            return
        sign = batch.sparkSession.createDataFrame([("put", bytearray(mark), bytearray(str(number).encode()), float("inf"))], "op string, k binary, v binary, ord double")
        rows = batch.select("op", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v"), F.col("ord").cast("double").alias("ord"))
        store.write_frame(rows.unionByName(sign))

    writer = ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_by_key(log: DataFrame, watermark: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Newest version of each key of a change stream, in update mode; for a batch the same rows as newest()."""
    if not log.isStreaming:
        return newest(log).select("k", "seq", "kind", "v")
    rows = log.withWatermark(watermark, delay) if watermark else log
    return rows.groupBy("k").agg(F.max_by(F.struct("seq", "kind", "v"), "seq").alias("t")).select("k", "t.seq", "t.kind", "t.v")
