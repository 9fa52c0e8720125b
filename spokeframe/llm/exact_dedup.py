"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition makes one run: its rows sorted by digest, one row left per
digest with the identifier that stays. Runs then meet in rounds, ``fan_in`` at a
time; a round sorts the runs that meet by digest, merges equal digests and keeps
the winner and the number of rows, until one run is left. A run is spread over
tasks by digest, and a digest has at most one row per run, so a group that holds a
third of the input is ``fan_in`` rows to whoever merges it.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import column, free_name, kept, lower_ascii, read_table

#: Digest of the normalised text, and two independent measures that verify it:
#: rows merge only where all three agree.
KEY = ("text_sha256", "n_bytes", "check")


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def digests(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """id, row, run (the partition that made it) and the verified digest of each row."""
    text = normalised(column(text_col))
    return docs.select(
        column(id_col).alias("id"),
        row.alias("row"),
        F.spark_partition_id().alias("run"),
        text.alias("normalised"),
    ).select(
        "id",
        "row",
        "run",
        F.sha2(F.encode("normalised", "utf-8"), 256).alias("text_sha256"),
        F.octet_length("normalised").cast("long").alias("n_bytes"),
        F.xxhash64("normalised").alias("check"),
    )


def merged_runs(rows: DataFrame, keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """One sorted run: per digest the winner (id, row) and the group's size.

    ``rows`` are stored digests. A struct of id and row is no fixed-width value, so
    Spark merges by sorting: each round is a merge of sorted runs.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    # An id of NULL loses against any other.
    has_id = F.col("id").isNotNull() if keep == "largest" else F.col("id").isNull()
    winner = F.struct(has_id.alias("has_id"), "id", "row")
    run = rows.select("run", *KEY, winner.alias("winner"), F.lit(1).cast("long").alias("group_size"))

    def merge(table: DataFrame) -> DataFrame:
        return table.groupBy("run", *KEY).agg(
            best("winner").alias("winner"), F.sum("group_size").alias("group_size")
        )

    run = merge(run)
    last = rows.agg(F.max("run")).first()[0] or 0
    while last:
        last //= fan_in
        run = merge(run.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")))
    return run.drop("run")


def flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty. Of
    rows with equal text the one with the smallest (``keep="largest"``: largest) id
    stays; of rows with that id and text exactly one. Ids of NULL lose against any
    other id; if all are NULL one row stays and keep_id is NULL. An empty table gives
    an empty result. Other columns, whatever their names, are not read.
    """
    rows = kept(digests(docs, id_col, text_col, F.monotonically_increasing_id()), "digests")
    return _flagged(rows, keep)


def _flagged(rows: DataFrame, keep: str) -> DataFrame:
    final = merged_runs(rows, keep)
    return rows.join(final, list(KEY)).select(
        F.col("id"),
        F.col("row"),
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        "text_sha256",
    )


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in :func:`flags`."""
    row = free_name(docs, "row_number")
    numbered = kept(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = kept(digests(numbered, id_col, text_col, F.col(row)), "digests")
    stays = _flagged(rows, keep).where("kept").select(F.col("row").alias(row))
    return numbered.join(stays, row, "left_semi").select([column(c) for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the largest id of its group of equal texts."""
    found = flags(read_table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(normalised) AS text_sha256
FROM (
  SELECT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normalised
  FROM documents
)
WINDOW same AS (PARTITION BY normalised)
"""
