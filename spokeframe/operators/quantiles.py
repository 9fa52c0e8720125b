"""Exact quantiles without bringing a column's values into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 4096
#: Rows that one task may rank at the end; brackets with more are narrowed further.
MOST_LEFT = 100_000
LARGEST = 1.7976931348623157e308
# A wanted value: the one at ``rank``, from 0, among the column's values between
# ``low`` and ``high``. ``upper`` tells the two neighbours of a quantile apart.
TARGET = ("column", "prob", "upper", "fraction", "rank")


def _magnitude(c: Column) -> Column:
    """Grows with the value, by one for a factor of e; the least double above 0 has 1 or more."""
    size = F.log(F.least(F.abs(c), F.lit(LARGEST))) + 746.0
    return F.when(c > 0, size).when(c < 0, -size).otherwise(0.0)


def _bin(scale: Callable[[Column], Column] = lambda c: c) -> Column:
    """Number of the bin between ``low`` and ``high``, of equal width on the scale; never falls as the value grows."""
    value, low, high = (scale(F.col(c)) for c in ("value", "low", "high"))
    width = high - low
    share = (value - low) / width * BINS
    infinite = F.lit(float("inf"))
    return (
        F.when(~(width > 0), 0)
        .when(width < infinite, F.least(F.floor(share), F.lit(BINS - 1)))
        .when(value == -infinite, 0)
        .when(value == infinite, BINS - 1)
        .otherwise(BINS // 2)
    )


def _rows(values: DataFrame) -> Column:
    """Number of rows, where ``values`` may stand for several each."""
    return F.sum("rows") if "rows" in values.columns else F.count(F.lit(1))


def _histogram(inside: DataFrame, *keys: str, number: Column | None = None) -> DataFrame:
    """Rows and extreme values per bin, with the rows before it."""
    binned = (
        inside.withColumn("bin", _bin() if number is None else number)
        .groupBy(*keys, "bin")
        .agg(
            _rows(inside).alias("rows"),
            F.min("value").alias("bin_low"),
            F.max("value").alias("bin_high"),
        )
    )
    return _with_before(binned, "bin", *keys)


def _with_before(counted: DataFrame, order: str, *keys: str) -> DataFrame:
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("before", F.sum("rows").over(running) - F.col("rows"))


def _holds_rank() -> Column:
    return (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("rows"))


def _in_bin(hits: DataFrame) -> DataFrame:
    """Targets narrowed to the bin that holds them."""
    relative = (F.col("rank") - F.col("before")).alias("rank")
    return hits.where(_holds_rank()).select(
        *TARGET[:-1], relative, F.col("bin_low").alias("low"), F.col("bin_high").alias("high"), F.col("rows").alias("left")
    )


def exact_quantiles(values: DataFrame, probs: Sequence[float], passes: int = 2) -> DataFrame:
    """Interpolated quantiles of every ``column`` in rows (``column``, ``value``).

    The built-in exact percentile keeps a count for each different value of a
    column in one aggregation buffer. Here each pass counts values in bins, which is
    combined before the shuffle and bounded by the number of bins, and goes on inside
    the bin that holds the wanted rank. The first pass has bins of equal ratio, so that
    outliers of any scale take no second one; later bins have equal width. There are
    ``passes`` of them, and more while a bin of different values holds more than
    MOST_LEFT rows; each leaves a 4096th of what doubles can tell apart, so that some
    seven end it. The values left over are then counted one by one, a value repeated any
    number of times being one row, and the rank is read off the running count: exact,
    whatever the distribution. The passes run when this is called.
    """
    present = values.where(F.col("value").isNotNull())
    # One row per column: safe to broadcast.
    ends = F.broadcast(
        present.groupBy("column").agg(
            F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
    )
    first = _histogram(present.join(ends, "column"), "column", "n", "low", "high", number=_bin(_magnitude))
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob")) for p in probs])).alias("wanted")
    side = F.explode(F.array(F.lit(False), F.lit(True))).alias("upper")
    position = (F.col("n") - 1) * F.col("wanted.prob")
    targets = _in_bin(
        first.select("*", wanted)
        .select("*", side)
        .withColumns(
            {
                "prob": F.col("wanted.prob"),
                "fraction": position - F.floor(position),
                "rank": F.when(F.col("upper"), F.ceil(position)).otherwise(F.floor(position)),
            }
        )
    )

    return ranked(present, targets, passes)


def ranked(present: DataFrame, targets: DataFrame, passes: int = 1) -> DataFrame:
    """The quantiles whose two neighbours are the ``targets`` among ``present`` (``column``, ``value``, perhaps ``rows``).

    ``passes`` counts the one that gave the targets.
    """

    def inside() -> DataFrame:
        # Two rows per column and probability: safe to broadcast.
        within = F.col("value").between(F.col("low"), F.col("high"))
        return present.join(F.broadcast(targets), "column").where(within)

    done = 1
    while True:
        # Two rows per column and probability: collected, so that no pass runs twice.
        brackets = targets.collect()
        targets = present.sparkSession.createDataFrame(brackets, targets.schema)
        wide = any(t["left"] > MOST_LEFT and t["low"] < t["high"] for t in brackets)
        if done >= passes and not wide:
            break
        targets = _in_bin(_histogram(inside(), *TARGET, "low", "high"))
        done += 1

    left = inside()
    counted = left.groupBy(*TARGET, "value").agg(_rows(left).alias("rows"))
    found = _with_before(counted, "value", *TARGET).where(_holds_rank())
    neighbours = found.groupBy("column", "prob", "fraction").agg(
        F.max(F.when(~F.col("upper"), F.col("value"))).alias("below"),
        F.max(F.when(F.col("upper"), F.col("value"))).alias("above"),
    )
    below, above, fraction = F.col("below"), F.col("above"), F.col("fraction")
    between = (1.0 - fraction) * below + fraction * above
    return neighbours.select(
        "column", "prob", F.when(below == above, below).otherwise(between).alias("quantile")
    )
