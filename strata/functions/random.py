"""A counter-based generator (SplitMix64) for reproducible workloads, over arrays and columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

# Fixed values of SplitMix64.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def scramble(x: np.ndarray | int) -> np.ndarray:
    """The generator's output for each counter, as unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = np.atleast_1d(np.asarray(x, np.uint64)) + np.uint64(STEP)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
        return z ^ (z >> np.uint64(31))


def random_bytes(seed: int, size: int) -> bytes:
    """The low bytes of the outputs from ``seed`` on."""
    with np.errstate(over="ignore"):
        return (scramble(np.uint64(seed) + np.arange(size, dtype=np.uint64)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


@pandas_udf(LongType())
def scrambled(x: pd.Series) -> pd.Series:
    """scramble() of a long column, in Arrow batches; the 64 bits as a signed long."""
    return pd.Series(scramble(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def permuted(n: int, seed: int = 1) -> np.ndarray:
    """The numbers under n in a fixed shuffled order."""
    return np.argsort(scramble(np.arange(n, dtype=np.uint64) ^ scramble(seed)), kind="stable")
