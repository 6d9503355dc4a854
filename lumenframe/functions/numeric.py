"""The roundings that pixel and geometry rules need; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, lo, hi) -> Column:
    return F.least(F.lit(hi) if not isinstance(hi, Column) else hi, F.greatest(F.lit(lo) if not isinstance(lo, Column) else lo, v))


def half_up(v: Column) -> Column:
    """floor(v + 1/2): halves go up, also below zero."""
    return F.floor(v + F.lit(0.5))


def byte_even(v: Column) -> Column:
    """Clamped to 0..255, then halves to even."""
    return F.rint(clamp(v, 0.0, 255.0)).cast("int")


def byte_floor(v: Column) -> Column:
    """A share of 1 as a byte: floor(255 v + 1/2), clamped."""
    return clamp(F.floor(v * 255.0 + 0.5), 0, 255).cast("int")


def micro(v: Column) -> Column:
    """Millionths, for comparing floating point results exactly."""
    return F.floor(v * 1000000.0 + 0.5).cast("long")


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def unsigned(content: Column, offset: int, n: int, little: bool = False) -> Column:
    """Unsigned integer of n bytes at a 0-based offset."""
    return unsigned_at(content, F.lit(offset + 1), n, little)


def unsigned_at(content: Column, start: Column, n: int, little: bool = False) -> Column:
    """The same at a 1-based start that may be a column."""
    if not little:
        return F.conv(F.hex(F.substring(content, start, F.lit(n))), 16, 10).cast("long")
    one = lambda k: F.conv(F.hex(F.substring(content, start + k, F.lit(1))), 16, 10).cast("long")
    return sum((one(k) * (1 << (8 * k)) for k in range(1, n)), one(0))


def signed32(v: Column) -> Column:
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)
