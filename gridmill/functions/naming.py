"""Names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snapshot_name(n: Column) -> Column:
    return F.format_string("s%05d", n)


def frame_name(n: Column) -> Column:
    return F.format_string("f%05d", n)


def point_cache_name(gx: Column, gy: Column) -> Column:
    return F.format_string("point_cache_%05d_%05d", gx, gy)


def time_label(start_unix: Column, seconds: Column) -> Column:
    """Calendar label in UTC of a start time and elapsed seconds; the session must run in UTC."""
    at = F.timestamp_seconds(start_unix.cast("long") + F.floor(seconds))
    return F.concat(F.date_format(at, "dd-MM-yyyy HH:mm:ss"), F.lit(" UTC"))


def _u32(x: Column) -> Column:
    return x.bitwiseAND(0xFFFFFFFF)


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2^32, in two halves so that no product leaves a long."""
    low, high = x.bitwiseAND(0xFFFF), F.shiftrightunsigned(x, 16)
    return _u32(low * k + F.shiftleft(_u32(high * k), 16))


# Constants of the stateless integer hash.
HASH_XOR, HASH_PRIME = 12345391, 2654435769


def integer_hash(seed: Column) -> Column:
    """32-bit hash of a seed, as a long."""
    i = _times(_u32(seed.cast("long").bitwiseXOR(F.lit(HASH_XOR))), HASH_PRIME)
    i = i.bitwiseXOR(_u32(F.shiftleft(i, 6)).bitwiseXOR(F.shiftrightunsigned(i, 26)))
    i = _times(i, HASH_PRIME)
    return _u32(i + _u32(F.shiftleft(i, 5)).bitwiseXOR(F.shiftrightunsigned(i, 12)))


def uniform(seed: Column) -> Column:
    """A number in [0, 1] from a seed."""
    return integer_hash(seed) / F.lit(float(0xFFFFFFFF))
