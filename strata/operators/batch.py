"""Batches of puts and deletes: checks, order, sequence numbers."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.schema import BATCH_BASE, DELETE, MAX_BATCH_BYTES, MAX_BATCH_OPS, MAX_KEY_BYTES, MAX_SEQUENCE, MAX_VALUE_BYTES, OP_BASE, PUT, InvalidArgument, SequenceExhausted


def check_op(k: bytes, v: bytes | None) -> None:
    if not isinstance(k, bytes) or not (v is None or isinstance(v, bytes)):
        raise InvalidArgument("keys and values are bytes")
    if len(k) > MAX_KEY_BYTES:
        raise InvalidArgument(f"a key has {len(k)} bytes; {MAX_KEY_BYTES} are allowed")
    if v is not None and len(v) > MAX_VALUE_BYTES:
        raise InvalidArgument(f"a value has {len(v)} bytes; {MAX_VALUE_BYTES} are allowed")


@dataclass
class WriteBatch:
    """Operations in order; a later one on the same key wins."""

    ops: list[tuple[int, bytes, bytes | None]] = field(default_factory=list)

    @classmethod
    def of(cls, items: Iterable[tuple]) -> WriteBatch:
        """From ("put", k, v) and ("delete", k); all are checked before any counts."""
        batch = cls()
        for item in items:
            if len(item) == 3 and item[0] == "put":
                batch.put(item[1], item[2])
            elif len(item) == 2 and item[0] == "delete":
                batch.delete(item[1])
            else:
                raise InvalidArgument(f"not an operation: {item[:1]!r} with {len(item)} parts")
        return batch

    def put(self, k: bytes, v: bytes) -> WriteBatch:
        if v is None:
            raise InvalidArgument("a put needs a value")
        check_op(k, v)
        self.ops.append((PUT, k, v))
        return self

    def delete(self, k: bytes) -> WriteBatch:
        check_op(k, None)
        self.ops.append((DELETE, k, None))
        return self

    def __len__(self) -> int:
        return len(self.ops)

    def check(self) -> None:
        if len(self.ops) > MAX_BATCH_OPS:
            raise InvalidArgument(f"a batch has {len(self.ops)} operations; {MAX_BATCH_OPS} are allowed")
        size = BATCH_BASE + sum(OP_BASE + len(k) + len(v or b"") for _, k, v in self.ops)
        if size > MAX_BATCH_BYTES:
            raise InvalidArgument(f"a batch has {size} bytes; {MAX_BATCH_BYTES} are allowed")

    def rows(self, last: int) -> list[tuple[bytes, int, int, bytes | None]]:
        """Log rows with the sequence numbers after ``last``."""
        if last + len(self.ops) > MAX_SEQUENCE:
            raise SequenceExhausted(f"{len(self.ops)} numbers after {last} are not left")
        return [(k, last + i, kind, v) for i, (kind, k, v) in enumerate(self.ops, 1)]


def faults(batch: DataFrame) -> DataFrame:
    """Rows of a batch frame (op, k, v, ord) that break a rule, with the reason."""
    why = (
        F.when(~F.coalesce(F.col("op").isin("put", "delete"), F.lit(False)), "unknown operation")
        .when(F.col("k").isNull(), "no key")
        .when(F.length("k") > MAX_KEY_BYTES, "key too long")
        .when((F.col("op") == "put") & F.col("v").isNull(), "put without value")
        .when((F.col("op") == "delete") & F.col("v").isNotNull(), "delete with value")
        .when(F.length("v") > MAX_VALUE_BYTES, "value too long")
    )
    return batch.withColumn("reason", why).where(F.col("reason").isNotNull())


def sequenced(batch: DataFrame, base: int) -> DataFrame:
    """Log rows of a batch frame with contiguous sequence numbers after ``base`` in the order of ord.

    Ranges of ord from approximate quantiles are ranked each on its own; their sizes, one number each,
    give the offsets. No task sees all rows. ord is a number; equal ones are ordered by key.
    """
    rows = batch.select("k", F.when(F.col("op") == "put", PUT).otherwise(DELETE).cast("byte").alias("kind"), "v", "ord")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile("ord", [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("ord"))) if bounds else F.lit(0)
    spread = rows.withColumn("_p", part)
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("ord", "k"))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.withColumn("_r", rank).join(F.broadcast(before.select("_p", "_base")), "_p").select("k", (F.lit(base) + F.col("_base") + F.col("_r")).cast("long").alias("seq"), "kind", "v")
