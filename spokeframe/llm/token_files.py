"""Token files: ids of all documents in id order, bit-packed in blocks.

The file format, written and read by Spark alone, so that it lives wherever Spark
can write, and a lost task leaves no torn file:

* ``<path>/blocks``: Parquet, a row per block of whole documents, in order within a
  shard: shard, block, width (bits of an id), n_tokens, doc_ids, starts (of each
  document in the block), payload (the packed ids).
* ``<path>/offsets``: a row per block: shard, block, start (ids in all blocks before
  it), n_tokens. Id number i of the corpus is found from it with one block's read.

Shards are ranges of document ids; ids within a shard are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.store import new_path
from .bitpack import pack, unpack, width_for
from .tables import column, read_table, shuffle_partitions
from .vocabulary import encoder, public_path
from .workers import forget

#: A block is closed by the first document that brings it to this many ids.
BLOCK_TOKENS = 1 << 18
BLOCKS = (
    "shard int, block int, width int, n_tokens long, doc_ids array<long>, starts array<long>, payload binary"
)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Encode every whole text and write the files in ascending id order.

    ``vocabulary`` is the path of a tokenizers file; ``end_id`` closes each document.
    A NULL or empty text is the end id alone. Ids of NULL come first; rows with equal
    ids stand in the order of their texts. An empty table gives files without rows.
    Other columns are not read.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(encoder)
        tokens = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        width, shard = width_for(max(tokens.size, end_id + 1)), TaskContext.get().partitionId()
        ids: list[int | None] = []
        parts: list[bytes] = []
        number = size = 0

        def block() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])])
            row = {
                "shard": [shard],
                "block": [number],
                "width": [width],
                "n_tokens": [int(starts[-1])],
                "doc_ids": [list(ids)],
                "starts": [starts[:-1].tolist()],
                "payload": [pack(np.frombuffer(b"".join(parts), "<u4"), width)],
            }
            return pa.RecordBatch.from_pydict(row, schema=ARROW_BLOCKS)

        for batch in batches:
            for doc, encoded in zip(batch.column(0).to_pylist(), tokens.encode_column(batch.column(1)), strict=True):
                ids.append(doc)
                parts.append(encoded + end)
                size += len(parts[-1]) // 4
                if size >= block_tokens:
                    yield block()
                    number, size, ids, parts = number + 1, 0, [], []
        if ids:
            yield block()

    spark = docs.sparkSession
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")

    # Sizes of shards and blocks: a few numbers per block.
    sizes = spark.read.parquet(f"{path}/blocks").select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("in_shard"))
    before = shards.select(
        "shard", (F.sum("in_shard").over(Window.orderBy("shard")) - F.col("in_shard")).alias("before")
    )
    in_order = Window.partitionBy("shard").orderBy("block")
    start = F.col("before") + F.sum("n_tokens").over(in_order) - F.col("n_tokens")
    sizes.join(before, "shard").select("shard", "block", start.alias("start"), "n_tokens").write.parquet(
        f"{path}/offsets"
    )


ARROW_BLOCKS = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("width", pa.int32()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


@dataclass(frozen=True)
class TokenFiles:
    """Written token files, read back."""

    spark: SparkSession
    path: str

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")

    def offsets(self) -> DataFrame:
        return self.spark.read.schema("shard int, block int, start long, n_tokens long").parquet(
            f"{self.path}/offsets"
        )

    def documents(self) -> DataFrame:
        """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids = unpack(row["payload"], row["width"], 0, row["n_tokens"]).astype("<u4")
                    ends = [*row["starts"][1:], row["n_tokens"]]
                    spans = list(zip(row["starts"], ends, strict=True))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": pa.array([row["shard"]] * len(spans), pa.int32()),
                            "block": pa.array([row["block"]] * len(spans), pa.int32()),
                            "doc_id": pa.array(row["doc_ids"], pa.int64()),
                            "within": pa.array(row["starts"], pa.int64()),
                            "n_tokens": pa.array([b - a for a, b in spans], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in spans], pa.int64()),
                        }
                    )

        rows = self.blocks().mapInArrow(
            read, "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long"
        )
        starts = self.offsets().select("shard", "block", "start")
        return rows.join(starts, ["shard", "block"]).select(
            "doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
        )

    def ids(self, start: int, count: int) -> DataFrame:
        """The ids ``start`` to ``start + count`` of the corpus: position, id.

        Only blocks that hold some of them are read, and of those only the ids asked for.
        """

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    low = max(0, start - row["start"])
                    high = min(row["n_tokens"], start + count - row["start"])
                    found = unpack(row["payload"], row["width"], low, high - low)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "position": pa.array(np.arange(low, high) + row["start"], pa.int64()),
                            "id": pa.array(found.astype(np.int64)),
                        }
                    )

        here = self.offsets().where((F.col("start") < start + count) & (F.col("start") + F.col("n_tokens") > start))
        wanted = self.blocks().join(here.select("shard", "block", "start"), ["shard", "block"])
        return wanted.select("width", "n_tokens", "payload", "start").mapInArrow(read, "position long, id long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level ids with end id 2, written, read back and checked."""
    path = new_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"), end_id=2)
    return TokenFiles(spark, path).documents()
