"""Date and time expressions; none depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONTHS, WEEKDAYS

# Fixed value: the text form of a trip timestamp.
TIMESTAMP_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$"

# Other forms of the same six numbers, year first. The two separators of a date are equal,
# as are those of a time. Without separators each number needs all its digits: 2022111
# could be 1 November or 11 January.
SEPARATED_TIMESTAMP = (
    r"^\s*(\d{4})([-/._])(\d{1,2})\2(\d{1,2})(?:\s+|\s*[T,]\s*)"
    r"(\d{1,2})([:.\-])(\d{1,2})\6(\d{1,2}(?:\.\d+)?)\s*Z?\s*$"
)
COMPACT_TIMESTAMP = r"^\s*(\d{4})(\d\d)(\d\d)[ T]?(\d\d)(\d\d)(\d\d(?:\.\d+)?)\s*Z?\s*$"


def parse_timestamp(text: Column) -> Column:
    """Wall-clock timestamp from text; NULL when the text is not one.

    The usual form is cast as it is; other separators, or none, are made usual first. A
    date that does not exist, another order of its parts and a zone other than Z are NULL.
    """
    separated = F.regexp_replace(text, SEPARATED_TIMESTAMP, "$1-$3-$4 $5:$7:$8")
    compact = F.regexp_replace(text, COMPACT_TIMESTAMP, "$1-$2-$3 $4:$5:$6")
    return (
        F.when(text.rlike(TIMESTAMP_PATTERN), text.try_cast("timestamp_ntz"))
        .when(text.rlike(SEPARATED_TIMESTAMP), separated.try_cast("timestamp_ntz"))
        .when(text.rlike(COMPACT_TIMESTAMP), compact.try_cast("timestamp_ntz"))
    )


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def month_text(date: Column) -> Column:
    return two_digits(F.month(date))


def day_text(date: Column) -> Column:
    return two_digits(F.dayofmonth(date))


def year_text(date: Column) -> Column:
    return F.lpad(F.year(date).cast("string"), 4, "0")


def day_index(date: Column) -> Column:
    """1 for Sunday … 7 for Saturday."""
    return F.dayofweek(date)


def weekday_name(date: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.dayofweek(date))


def month_abbreviation(month_number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month_number)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end``, fractions kept.

    Subtracting zone-less timestamps never consults the session time zone, so a
    clock change inside the ride does not alter its length.
    """
    return (end - start).cast("interval second").cast("decimal(18,6)").cast("double")
