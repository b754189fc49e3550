"""Keys in unsigned byte order: bounds of a prefix, encoders that keep order, as values and as columns."""

from __future__ import annotations

import os.path

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = (1 << 64) - 1


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key over all keys with the prefix; None if there is none."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def separator(low: bytes, high: bytes) -> bytes:
    """A short key s with low <= s < high."""
    n = len(os.path.commonprefix([low, high]))
    if n < len(low) and n < len(high) and low[n] + 1 < high[n]:
        return low[:n] + bytes([low[n] + 1])
    return low


def common_prefix(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix([a, b]))


def u64_key(i: int) -> bytes:
    return i.to_bytes(8, "big")


def descending(i: int) -> int:
    """Order-reversing image of an unsigned 64-bit number."""
    return U64_MAX - i


def u64_key_of(column: Column) -> Column:
    """Eight bytes, most significant first, of a non-negative long."""
    return F.unhex(F.lpad(F.hex(column), 16, "0"))


def padded(prefix: str, column: Column, width: int) -> Column:
    """Text key with a zero-padded number, which sorts as the number."""
    return F.concat(F.lit(prefix), F.lpad(column.cast("string"), width, "0"))


def descending_text(column: Column) -> Column:
    """Twenty digits of 2^64 - 1 - column; sorts from the newest to the oldest."""
    return F.lpad((F.lit(str(U64_MAX)).cast("decimal(20,0)") - column.cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")


#: FNV-1a of 64 bits. The offset basis as a signed number, and the prime 2^40 + 435.
FNV_BASIS = 14695981039346656037 - (1 << 64)
FNV_LOW = 435


def fnv1a(data: Column) -> Column:
    """64-bit FNV-1a of binary values, as a signed long. The product is put together from halves, as a long must not overflow."""
    word = F.lit(0xFFFFFFFF)

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        low, high = x.bitwiseAND(word), F.shiftrightunsigned(x, 32)
        product = low * FNV_LOW
        top = (high * FNV_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)).bitwiseAND(word)
        return F.shiftleft(top, 32).bitwiseOR(product.bitwiseAND(word))

    places = F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(1)))
    each = F.transform(places, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    basis = F.lit(FNV_BASIS).cast("long")
    return F.when(F.length(data) == 0, basis).otherwise(F.aggregate(each, basis, step))


def in_range(k: Column, start: bytes | str | None, end: bytes | str | None) -> Column:
    """start <= k < end; None is unbounded, an empty end is an empty range. Both bounds reach the scan."""
    ok = F.lit(True) if start is None or len(start) == 0 else k >= F.lit(start)
    return ok if end is None else ok & (k < F.lit(end))


def has_prefix(k: Column, prefix: bytes | str) -> Column:
    """A range, since a test of binary prefixes does not reach the scan."""
    raw = prefix.encode() if isinstance(prefix, str) else prefix
    end = prefix_end(raw)
    if end is not None and isinstance(prefix, str):
        end = end.decode("utf-8", "surrogatepass") if raw.isascii() and end.isascii() else None
        if end is None:
            return k.startswith(prefix)
    return in_range(k, prefix, end)
