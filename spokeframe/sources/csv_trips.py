"""Trip files in CSV form: one file or folder per month, with a header."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import COORDINATE_COLUMNS, MONTHS, SOURCE_COLUMNS
from .listing import SourceFile, headers, list_files

# How the files spell a missing value and name themselves.
MISSING_TEXT = "NA"
MONTH_FILES = tuple(f"{month}_trips.csv" for month in MONTHS)


def month_paths(folder: str) -> list[str]:
    """The twelve monthly files of a folder, in calendar order."""
    return [f"{folder.rstrip('/')}/{name}" for name in MONTH_FILES]


def month_of_path(path: Column) -> Column:
    """The month in the name of a monthly file, or of a ``month_file=`` folder."""
    return F.regexp_extract(path, r"(?:/|month_file=)([A-Z][a-z]{2})(?:_trips\.csv|/)", 1)


def _reader(spark: SparkSession, multiline: bool):
    # A quote inside a quoted field is doubled; a backslash is an ordinary character.
    # Every file's own header is compared with the schema: other columns, or the same in
    # another order, are an error and not values in the wrong column.
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multiline)
    )


def normalize_missing(df: DataFrame) -> DataFrame:
    """Apply the missing-value rule to columns read as text.

    The text ``NA`` is missing. A blank text field is an empty string, not
    missing (the reader delivers it as NULL). A blank or malformed coordinate is
    missing. Timestamps stay text here: they are parsed after incomplete rows
    have been dropped.
    """

    def rule(field: T.StructField):
        value = F.col(field.name)
        if field.name in COORDINATE_COLUMNS:
            return F.trim(value).try_cast("double").alias(field.name)
        present = F.coalesce(value, F.lit(""))
        return F.when(present != MISSING_TEXT, present).alias(field.name)

    return df.select(*[rule(f) for f in df.schema.fields])


def read_trips(
    spark: SparkSession,
    paths: Iterable[str],
    *,
    source_column: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """All rows of the given files, columns matched by header name.

    Files that share a header are one scan, so twelve months of the same layout
    are one set of splits rather than twelve. Files of one folder may order their
    columns differently; which columns there are must be the same everywhere. A file
    without a line gives no rows. ``source_column`` adds the path
    each row came from. ``multiline`` allows line breaks inside quotes at the
    price of one task per file.
    """
    paths = list(paths)
    if not paths:
        raise ValueError("no trip files given")
    by_header: dict[tuple[str, ...], list[SourceFile]] = defaultdict(list)
    for file, header in headers(spark, list_files(spark, paths)).items():
        by_header[header].append(file)
    if not by_header:
        raise ValueError("no trip files with a header")
    known = list(by_header)
    for header in known:
        missing = set(SOURCE_COLUMNS) - set(header)
        if missing:
            raise ValueError(f"{by_header[header][0].path} lacks {sorted(missing)}")
        if set(header) != set(known[0]):
            raise ValueError(f"{by_header[header][0].path} differs in columns from {by_header[known[0]][0].path}")

    def scan(header: tuple[str, ...]) -> DataFrame:
        text = T.StructType([T.StructField(name, T.StringType()) for name in header])
        # With one layout the paths as given are a shorter plan than all files.
        of = paths if len(known) == 1 else [file.literal() for file in by_header[header]]
        rows = _reader(spark, multiline).schema(text).csv(of)
        if source_column is None:
            return normalize_missing(rows)
        return normalize_missing(rows.select("*", F.col("_metadata.file_path").alias(source_column)))

    return append_all(scan(header) for header in known)


def append_all(tables: Iterable[DataFrame]) -> DataFrame:
    """Rows of all tables, duplicates kept, columns matched by name."""
    return reduce(DataFrame.unionByName, tables)
