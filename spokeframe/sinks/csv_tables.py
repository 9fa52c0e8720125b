"""CSV output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW_NUMBER = "row_number"


def write_ranked_csv(table: DataFrame, path: str, order: Sequence[Column], rows: int, mode: str = "errorifexists") -> None:
    """Write the first ``rows`` rows as one CSV file led by a row number.

    Numbering brings them together in one task, so the limit must be a small one.
    Use :func:`write_csv` for a whole table.
    """
    numbered = table.orderBy(*order).limit(rows).select(F.row_number().over(Window.orderBy(*order)).alias(ROW_NUMBER), "*")
    write_csv(numbered.coalesce(1).sortWithinPartitions(ROW_NUMBER), path, mode)


def write_csv(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a table as CSV with a header, one file per partition."""
    table.write.mode(mode).option("header", True).option("escape", '"').csv(path)
