"""How an operator hands over a small intermediate table for storing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

# Takes a table and returns it stored. A join with a stored table is planned by
# the size of its files: broadcast when small, shuffled otherwise. Left in the
# plan, an aggregate counts as large and the other side would be shuffled whole.
Keep = Callable[[DataFrame], DataFrame]


def as_planned(table: DataFrame) -> DataFrame:
    """Store nothing."""
    return table
