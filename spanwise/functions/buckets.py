"""Monotone bucketing, so that ordered work can be split below one key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS_PER_OCTAVE = 64
# Larger than STEPS_PER_OCTAVE times the exponent range of a double.
_SHIFT = 1100 * STEPS_PER_OCTAVE
# Beyond all finite values.
_END = 4 * _SHIFT


def log_bucket(value: Column) -> Column:
    """Order-preserving integer bucket of a double: 64 equal steps per power of two, never null.

    A key has at most a few thousand buckets in use, whatever its row count. Infinite values and NaN have end buckets.
    """
    size = F.abs(value.cast("double"))
    size = F.when(size < float("inf"), size)
    octave = F.floor(F.log2(size))
    scale = F.pow(F.lit(2.0), octave.cast("double"))
    index = octave * STEPS_PER_OCTAVE + F.floor((size / scale - 1) * STEPS_PER_OCTAVE) + _SHIFT
    index = F.when(value.isNotNull() & size.isNull(), F.lit(_END)).otherwise(index)
    signed = F.when(value > 0, index).when(value < 0, -index)
    return F.coalesce(signed, F.lit(0)).cast("long")


def chunk(value: Column, width: float) -> Column:
    """Fixed-width bucket of a number."""
    return F.floor(value / F.lit(width)).cast("long")


def floor_div(value: Column, width: int) -> Column:
    """Whole division of a long by a positive width, rounded down, without going through doubles."""
    return ((value - F.pmod(value, F.lit(width).cast("long"))) / width).cast("long")
