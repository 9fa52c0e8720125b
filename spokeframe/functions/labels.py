"""Text labels for counts, shares and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_half_even


def thousands(number: Column) -> Column:
    """1234567 → ``1,234,567``."""
    return F.format_number(number, 0)


def short_count(number: Column) -> Column:
    """1234567 → ``1.2M``, 25000 → ``25K``, 999 → ``999``."""

    def shortened(unit: float, suffix: str) -> Column:
        rounded = round_half_even(number / unit, 1)
        return F.concat(F.call_function("format_number", rounded, F.lit("0.#")), F.lit(suffix))

    return (
        F.when(number >= 1_000_000, shortened(1e6, "M"))
        .when(number >= 1_000, shortened(1e3, "K"))
        .otherwise(thousands(number))
    )


def percent_label(percent: Column) -> Column:
    """43.0 → ``43%``."""
    return F.concat(percent.cast("bigint").cast("string"), F.lit("%"))


def legend_label(name: Column, count: Column) -> Column:
    """casual, 1234 → ``Casual (1,234)``."""
    capital = F.concat(F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2)))
    return F.concat(capital, F.lit(" ("), thousands(count), F.lit(")"))


def spaced(name: Column) -> Column:
    """electric_bike → ``electric bike``."""
    return F.replace(name, F.lit("_"), F.lit(" "))


def level_rank(value: Column, levels: Sequence[str]) -> Column:
    """Position of ``value`` in a fixed order, from 1; NULL when not listed."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), value), F.lit(0))
