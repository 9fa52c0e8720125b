"""Reading the given tables, and writing what must be cut from its lineage."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import deleted, new_path

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def kept(table: DataFrame, name: str) -> DataFrame:
    """``table`` written to the shared folder and read back.

    A lost executor then costs a re-read of files, and values that depend on the
    partitioning (row ids) are fixed from here on. The files stay, unless
    someone who :func:`noted` them drops them.
    """
    path = new_path(table.sparkSession, name)
    note = _NOTED.get()
    if note is not None:
        note.append(path)
    table.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of all tables that are :func:`kept` meanwhile."""
    paths: list[str] = []
    before = _NOTED.set(paths)
    try:
        yield paths
    finally:
        _NOTED.reset(before)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing yet to be computed needs."""
    for path in paths:
        deleted(spark, path)


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, a job's shuffle files go when it ends: for work whose every step is a written table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def free_name(table: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``table`` has that name."""
    taken = {c.lower() for c in table.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + re.sub("`", "``", name) + "`")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, CAPITALS, CAPITALS.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; the id NULL counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % folds
