"""Column profiles and data-quality checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import cleaning
from .cleaning import DERIVED_COLUMNS
from .keeping import Keep, as_planned
from .sketched import column_quantiles

QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("first_quartile", "median", "third_quartile")
LARGEST_SPLIT = 1e38  # beyond it a value is no single-precision number


def columns_of(table: DataFrame, kind: type[T.DataType]) -> list[str]:
    return [f.name for f in table.schema.fields if isinstance(f.dataType, kind)]


def long_form(table: DataFrame) -> DataFrame:
    """Rows (``column``, ``value``) of columns of one type; ``column`` is their position.

    A number, as a join on it is several times faster than one on the name.
    """
    pairs = ", ".join(f"{i}L, `{name}`" for i, name in enumerate(table.columns))
    return table.select(F.expr(f"stack({len(table.columns)}, {pairs}) AS (column, value)"))


def _per_column(table: DataFrame, columns: Sequence[str], **measures: Callable[[Column], Column]) -> DataFrame:
    """One row per column with the given aggregates of it, in one pass over the table."""
    wide = table.agg(
        *[
            F.struct(
                F.lit(name).alias("column"), *[m(F.col(name)).alias(label) for label, m in measures.items()]
            ).alias(f"of_{i}")
            for i, name in enumerate(columns)
        ]
    )
    entries = F.array(*[F.col(f"of_{i}") for i in range(len(columns))])
    return wide.select(F.explode(entries).alias("entry")).select("entry.*")


def _leading(c: Column) -> Column:
    return c.cast("float").cast("double")


# A mean's sums: the leading 24 bits of each value apart from the rest (the first sum is exact for
# values of like size, the second too small to matter beyond thirteen digits), and infinite values
# by themselves.
_SUMS = {
    "leading": lambda c: F.when(F.abs(c) < LARGEST_SPLIT, _leading(c)).otherwise(c),
    "rest": lambda c: F.when(F.abs(c) < LARGEST_SPLIT, c - _leading(c)).otherwise(F.when(c.isNotNull(), 0.0)),
    "infinite": lambda c: F.when(F.abs(c) == float("inf"), c),
}
NUMERIC = (
    "column string, minimum double, first_quartile double, median double, mean double,"
    " third_quartile double, maximum double, na_count bigint"
)


def _mean_of(column: dict) -> float | None:
    """The mean to thirteen digits, however rows are spread."""
    if not column["n"]:
        return None
    whole = column["infinite"]
    mean = whole if whole is not None else (column["leading"] + column["rest"]) / column["n"]
    return float("%.12e" % mean)


def profile_numeric(table: DataFrame, columns: Sequence[str] | None = None, keep: Keep = as_planned) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count of numeric columns.

    Scans ``table`` twice, or once more in the rare case that a sketch's bracket misses its
    quartile, when this is called: give a stored table, not a costly plan. ``keep`` stores
    the second scan's counts; without it they are counted each time they are read.
    """
    columns = list(columns or columns_of(table, T.DoubleType))
    spark = table.sparkSession
    if not columns:
        return spark.createDataFrame([], NUMERIC)
    # NaN is a missing value.
    numbers = table.select(*[F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) for c in columns])
    found = [
        (name, c["low"], *(c["quantiles"].get(p) for p in QUARTILES[:2]), _mean_of(c), c["quantiles"].get(QUARTILES[2]), c["high"], c["rows"] - c["n"])
        for name, c in zip(columns, column_quantiles(numbers, QUARTILES, _SUMS, keep), strict=True)
    ]
    return spark.createDataFrame(found, NUMERIC)


def profile_dates(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The numeric profile of date columns; a quartile or mean inside a day is that day.

    One scan: rows are counted per day first, and all statistics are read off the counts,
    of which there are as many as the calendar has days.
    """
    columns = list(columns or columns_of(table, T.DateType))
    days = table.select(*[F.unix_date(c).cast("bigint").alias(c) for c in columns])
    counted = long_form(days).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    day, filled = F.col("value"), F.when(F.col("value").isNotNull(), F.col("rows"))
    same = Window.partitionBy("column")
    running = same.orderBy(F.asc_nulls_last("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumns({"n": F.sum(filled).over(same), "upto": F.sum("rows").over(running)})

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("rows") <= rank) & (rank < F.col("upto")), day))

    def quantile(prob: float) -> Column:
        position = (F.col("n") - 1) * F.lit(prob)
        share = F.first(position - F.floor(position))
        return (1.0 - share) * at(F.floor(position)) + share * at(F.ceil(position))

    def as_date(number: Column, name: str) -> Column:
        return F.date_from_unix_date(F.floor(number).cast("int")).alias(name)

    first, median, third = (as_date(quantile(p), name) for p, name in zip(QUARTILES, QUARTILE_NAMES))
    found = ranked.groupBy("column").agg(
        as_date(F.min(day), "minimum"),
        first,
        median,
        as_date(F.sum(day * F.col("rows")) / F.sum(filled), "mean"),
        third,
        as_date(F.max(day), "maximum"),
        F.coalesce(F.sum(F.when(day.isNull(), F.col("rows"))), F.lit(0)).alias("na_count"),
    )
    # One row per column, also where the table is empty.
    names = F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("position", "name")
    listed = table.sparkSession.range(1).select(names)
    return listed.join(found, F.col("position") == F.col("column"), "left").select(
        F.col("name").alias("column"),
        *found.columns[1:-1],
        F.coalesce("na_count", F.lit(0)).cast("bigint").alias("na_count"),
    )


def profile_text(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Length, class, mode, missing and blank counts of text columns."""
    return _per_column(
        table,
        columns or columns_of(table, T.StringType),
        length=lambda c: F.count(F.lit(1)),
        **{"class": lambda c: F.lit("character"), "mode": lambda c: F.lit("character")},
        na_count=lambda c: F.count_if(c.isNull()),
        blank_count=lambda c: F.count_if(c == ""),
    )


def profile_shape(table: DataFrame) -> DataFrame:
    """Name, position, class and filled rows of every column, and the column count."""
    filled = _per_column(table, table.columns, filled_rows=F.count)
    classes = [
        F.struct(F.lit(i).alias("position"), F.lit(f.dataType.simpleString()).alias("class"))
        for i, f in enumerate(table.schema.fields, start=1)
    ]
    names = F.array(*[F.lit(c) for c in table.columns])
    known = F.element_at(F.array(*classes), F.array_position(names, F.col("column")).cast("int"))
    return filled.select(
        known["position"].alias("position"),
        "column",
        known["class"].alias("class"),
        "filled_rows",
        F.lit(len(classes)).alias("column_count"),
    )


def cleaning_audit(trips: DataFrame, incomplete: Sequence[str] | None = None) -> DataFrame:
    """How many rows each cleaning rule removes, in one pass.

    ``rows_incomplete`` is counted over all rows; the other rules over complete
    rows, each on its own, so a row can count under several.
    """
    # Before the timestamps are parsed: an unreadable one is not a missing value.
    lacking = F.lit(False)
    for name in incomplete or trips.columns:
        lacking = lacking | ~cleaning.is_present(trips, name)
    audited = cleaning.derive(trips.withColumn("incomplete", lacking))
    complete = ~F.col("incomplete")
    rules = {
        "rows_too_short": cleaning.long_enough(),
        "rows_without_distance": cleaning.went_somewhere(),
        "rows_maintenance_start": cleaning.not_maintenance_start(),
        "rows_maintenance_end": cleaning.not_maintenance_end(),
    }
    kept = complete
    for rule in rules.values():
        kept = kept & rule
    return audited.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col("incomplete")).alias("rows_incomplete"),
        *[F.count_if(complete & ~F.coalesce(rule, F.lit(False))).alias(n) for n, rule in rules.items()],
        F.count_if(kept).alias("rows_clean"),
    )


def repeated_rows(
    table: DataFrame, columns: Sequence[str] | None = None, keep: Keep = as_planned
) -> DataFrame:
    """Every set of equal rows with more than one member, and its size.

    Full rows are only compared where a 64-bit hash occurs more than once: first
    the hashes alone are counted, then the rows behind repeated hashes are
    compared in full, so equal hashes of different rows do no harm. ``keep``
    stores the repeated hashes in between, few or none as a rule, so that rows
    without one are dropped where they are read instead of being shuffled.
    """
    columns = list(columns or table.columns)
    hashed = table.select(*columns).withColumn("row_hash", F.xxhash64(*[_hash_input(table, c) for c in columns]))
    repeated = hashed.groupBy("row_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    suspects = hashed.join(keep(repeated.select("row_hash")), "row_hash", "left_semi")
    counted = suspects.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    return counted.where(F.col("copies") > 1)


def _hash_input(table: DataFrame, name: str) -> Column:
    """Equal values must hash equally: -0.0 becomes 0.0."""
    if isinstance(table.schema[name].dataType, T.DoubleType):
        return F.col(name) + F.lit(0.0)
    return F.col(name)


def has_duplicate_rows(
    table: DataFrame, columns: Sequence[str] | None = None, keep: Keep = as_planned
) -> DataFrame:
    """One row: does any full row occur twice?"""
    return repeated_rows(table, columns, keep).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_duplicates"))


def has_duplicate_trips(trips: DataFrame, keep: Keep = as_planned) -> DataFrame:
    """Duplicate check of trips on all their columns but the derived ones, which follow from these."""
    return has_duplicate_rows(trips, [c for c in trips.columns if c not in DERIVED_COLUMNS], keep)
