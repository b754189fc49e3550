"""The change log: one row for each version of a key; limits and error types."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, ByteType, LongType, StructField, StructType

PUT, DELETE = 1, 2

LOG_SCHEMA = StructType([StructField("k", BinaryType(), False), StructField("seq", LongType(), False), StructField("kind", ByteType(), False), StructField("v", BinaryType(), True)])

# Fixed values of the storage contract.
MAX_KEY_BYTES = 1 << 20
MAX_VALUE_BYTES = 16 << 20
MAX_BATCH_OPS = 100_000
MAX_BATCH_BYTES = 64 << 20
#: A batch counts 13 bytes, and 9 more than key and value for each operation.
BATCH_BASE, OP_BASE = 13, 9
#: Sequence numbers are signed longs here, so they end at 2^63 - 1.
MAX_SEQUENCE = (1 << 63) - 1


class StrataError(Exception):
    """Base of all errors of the store."""


class InvalidArgument(StrataError):
    """An argument is out of bounds; nothing was changed."""


class Locked(StrataError):
    """Another owner has the directory."""


class SequenceExhausted(StrataError):
    """No sequence number is left; nothing was changed."""


class Corrupt(StrataError):
    """Stored state contradicts its checksum or the manifest."""


class CommitFailed(StrataError):
    """The manifest was not replaced."""


class CommitAmbiguous(StrataError):
    """The manifest was replaced but may not be durable; reopen to learn which holds."""


class Poisoned(StrataError):
    """An earlier commit failed; the store refuses changes until it is opened again."""


class MaintenanceError(StrataError):
    """Background maintenance failed."""
