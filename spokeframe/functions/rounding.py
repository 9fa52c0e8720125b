"""Rounding and exact arithmetic on two-decimal measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """Round a double to ``digits`` places, ties to the even neighbour.

    The two neighbouring ``digits``-place values are compared by their distance
    to ``value`` in floating point, so 2.675 (stored just below the tie) gives
    2.67. Plain arithmetic only: no decimal objects per row, unlike ``bround``.
    """
    if digits == 0:
        return F.rint(value)
    scale = 10.0**digits
    scaled = value * scale
    near = F.rint(scaled)
    floor = F.when(near > scaled, near - 1.0).otherwise(near)
    ceiling = F.when(near < scaled, near + 1.0).otherwise(near)
    below, above = floor / scale, ceiling / scale
    to_below, to_above = value - below, above - value
    take_below = (to_below < to_above) | ((to_below == to_above) & (floor % 2.0 == 0.0))
    return F.when(take_below, below).otherwise(above)


def nearest(value: Column, digits: int) -> Column:
    """Round a measure that does not fall on a tie.

    Equal to :func:`round_half_even` there, and reads ``value`` once: the rule
    above repeats it, which costs where a long expression is rounded per row.
    """
    scale = 10.0**digits
    return F.rint(value * scale) / scale


def percent_of(part: Column, whole: Column, digits: int = 0) -> Column:
    """``part / whole * 100`` in that order, rounded half to even."""
    return round_half_even(part / whole * 100.0, digits)


def hundredths(value: Column) -> Column:
    """A two-decimal measure as a whole number of hundredths.

    Sums of these are exact, so totals and means do not depend on how the rows
    are partitioned or in which order partial sums are merged.
    """
    return F.rint(value * 100.0).cast("bigint")


def from_hundredths(total: Column) -> Column:
    return total / 100.0
