"""The files behind given paths: their versions and their headers."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADER_READERS = 12


@dataclass(frozen=True, order=True)
class SourceFile:
    """One version of a file: rewriting it gives another size or time."""

    path: str
    uri: str  #: as a scan names the file in ``_metadata.file_path``
    size: int
    modified_ms: int

    def literal(self) -> str:
        """The path with nothing in it that a reader would take for a pattern."""
        return re.sub(r"([\\{}\[\]*?])", r"\\\1", self.path)


def list_files(spark: SparkSession, paths: Iterable[str]) -> list[SourceFile]:
    """All files of the given files, folders and patterns; no content is read."""
    found = (
        spark.read.format("binaryFile")
        .load(list(paths))
        .select("path", "_metadata.file_path", "length", F.unix_millis("modificationTime").alias("modified_ms"))
    )
    return sorted(SourceFile(*row) for row in found.collect())  # one row per file


def headers(spark: SparkSession, files: list[SourceFile]) -> dict[SourceFile, tuple[str, ...]]:
    """The columns that each file names in its first line; files without a line are left out.

    Only the beginnings of files are read, many at a time, and without a Spark job.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def first_line(file: SourceFile) -> str | None:
        place = jvm.org.apache.hadoop.fs.Path(file.path)
        stream = place.getFileSystem(conf).open(place)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
            plain = stream if codec is None else codec.createInputStream(stream)
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
            line = lines.readLine()
            while line is not None and not line.strip():
                line = lines.readLine()
            return line
        finally:
            stream.close()

    if not files:
        return {}
    with ThreadPoolExecutor(min(len(files), HEADER_READERS)) as pool:
        lines = pool.map(first_line, files)
        return {file: tuple(next(csv.reader([line]))) for file, line in zip(files, lines, strict=True) if line}
