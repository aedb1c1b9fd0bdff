"""Numeric column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom import fixed_values as fv

_INFINITY = float("inf")


def is_finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; Spark orders NaN above infinity."""
    return F.coalesce(F.abs(value) < _INFINITY, F.lit(False))


def finite_or_zero(value: Column) -> Column:
    return F.when(F.abs(value) < _INFINITY, value).otherwise(F.lit(0.0))


def total(columns, start: float | int = 0.0) -> Column:
    """Sum of columns in the given order."""
    return reduce(lambda a, b: a + b, columns, F.lit(start))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0.0 where the whole is zero."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def hash_order(identity: Column, seed: int = fv.SEED) -> Column:
    """A seeded random order key: the same row always gets the same key, on any cluster."""
    return F.md5(F.concat(F.lit(f"{seed}|"), identity.cast("string")))


def hash_fraction(identity: Column, seed: int = fv.SEED) -> Column:
    """A seeded number in [0, 1) per row, from the first 32 bits of its order key."""
    bits = F.conv(F.substring(hash_order(identity, seed), 1, 8), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(float(2**32))


def fixed_decimals(value: Column, digits: int, *, half_up: bool = False) -> Column:
    """Text of a number with a fixed count of decimals.

    Exact ties such as 81.25 go to the even digit unless ``half_up`` is set. Numbers beyond the
    decimal range fall back to plain formatting.
    """
    rounding = F.round if half_up else F.bround
    exact = rounding(value.try_cast("decimal(38,18)"), digits)
    return F.coalesce(exact.cast("string"), F.format_string(f"%.{digits}f", value))
