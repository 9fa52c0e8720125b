"""Intermediate tables written once per application and read by many reports.

Writing cuts the lineage: a lost executor costs a re-read of a file, not the
cleaning of the whole input. Tables go to the session's shared checkpoint
folder, each into a new directory, and are never overwritten.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import shared_folder

_FOLDERS: dict[str, str | None] = {}
_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType | None]] = {}
_LOCK = threading.RLock()


def scratch_folder(spark: SparkSession) -> str | None:
    """This application's folder for intermediate tables, if it may have one."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _FOLDERS:
            base = shared_folder(spark)
            _FOLDERS[app] = base and f"{base.rstrip('/')}/spokeframe-{app}"
        return _FOLDERS[app]


def new_path(spark: SparkSession, name: str) -> str:
    folder = scratch_folder(spark)
    if folder is None:
        raise RuntimeError("this needs a shared folder: set spark.checkpoint.dir")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written_once(
    spark: SparkSession, source: str, name: str, write: Callable[[str], StructType | None]
) -> tuple[str, StructType | None]:
    """Path (and schema) of what ``write`` puts there, made on first use for this source."""
    key = (spark.sparkContext.applicationId, source, name)
    with _LOCK:
        if key not in _WRITTEN:
            path = new_path(spark, name)
            _WRITTEN[key] = (path, write(path))
        return _WRITTEN[key]


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a written table that is not read again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, steps are not fused into methods longer than the JVM compiles, which would be interpreted."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a stored table; computed in place where nothing may be stored."""
    if scratch_folder(spark) is None:
        return build()

    def write(path: str) -> StructType:
        table = build()
        table.write.parquet(path)
        return table.schema

    path, schema = written_once(spark, source, name, write)
    return spark.read.schema(schema).parquet(path)
