"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents are encoded and cut into pieces of at most ``capacity`` ids. Pieces are dealt
to groups, and each group is packed by best-fit decreasing. Dual-feasible functions
bound from below how many sequences a group needs. A group that uses more than its
bound, or that leaves sequences open, gives the documents of its emptiest sequences to
the next round, in which at most half as many groups share what was given and pack it
again, until one group is left. What a group gives is at most half of what a group
packs at once, so no group of any round grows with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import column, kept, read_table
from .vocabulary import encoder, public_path
from .workers import forget

CAPACITY = 2048
GROUP_PIECES = 8192  #: pieces that one group packs at once, about
FAN_IN = 8  #: groups of a round that meet in one group of the next
STEPS = 32  #: dual-feasible functions by steps that are tried
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's ids, closed by ``end_id``, as pieces of at most ``capacity`` ids.

    A NULL or empty text is the end id alone. Rows are independent: repeated rows and
    NULL ids give pieces of their own. Other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(encoder)
        tokens = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least, by the best dual-feasible function of two families.

    ``counts[n]`` is the number of pieces of length n. For each t up to half the
    capacity, lengths above capacity - t count as a whole sequence, those below t as
    nothing, the rest by their share. For each k, a length counts as the k-th part of
    the whole multiples of capacity / (k + 1) in it, or by its share where it is such a
    multiple. No set that fits a sequence counts more than one.
    """
    lengths = np.arange(capacity + 1)
    above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # above[n]: pieces of n or more
    area = np.concatenate([np.cumsum((counts * lengths)[::-1])[::-1], [0]])
    t = np.arange(capacity // 2 + 1)
    whole = above[capacity - t + 1]
    share = area[t] - area[capacity - t + 1]
    best = int(np.max(whole + -(-share // capacity), initial=0))
    for k in range(1, STEPS + 1):
        steps, rest = np.divmod((k + 1) * lengths, capacity)
        total = int((counts * np.where(rest == 0, k * lengths, capacity * steps)).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece. Ties between pieces go by position, between bins to the latest."""
    bins = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what still fits
    some, count = 0, 0  # bit r of some: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            found = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            left, found, count = capacity, count, count + 1
        bins[i] = found
        room[left - size].append(found)
        some |= 1 << (left - size)
    return bins


def _pack_group(capacity: int, most: int):
    """Packs one group; ``again`` marks up to ``most`` pieces that go on to the next round."""

    def run(table: pa.Table) -> pa.Table:
        order = ("doc_id", "piece", "start", "length", "ids_crc32")
        table = table.sort_by([(c, "ascending") for c in order])
        lengths = table.column("length").to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        gap = len(fill) - bound
        again = np.zeros(len(fill), bool)
        if most and len(fill):
            emptiest = np.argsort(fill, kind="stable")
            if gap == 0:  # certified: only the emptiest bin may still serve others
                emptiest = emptiest[:1]
            emptiest = emptiest[fill[emptiest] < capacity]
            given = np.cumsum(np.bincount(bins)[emptiest])
            again[emptiest[given <= most]] = True
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[by_bin])
        offset = np.empty(len(lengths), np.int64)
        offset[by_bin] = ends - lengths[by_bin] - (np.cumsum(fill) - fill)[bins[by_bin]]
        group, round_ = table.column("group").to_numpy(), table.column("round").to_numpy()
        number = (round_.astype(np.int64) << 56) | (group.astype(np.int64) << 28) | bins
        keep = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "group"])
        return (
            keep.append_column("sequence_id", pa.array(number))
            .append_column("offset", pa.array(offset))
            .append_column("again", pa.array(again[bins] if len(fill) else np.zeros(0, bool)))
        )

    return run


def packed(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``items`` (as from :func:`pieces`, stored) with sequence_id and offset.

    Sequence ids are any numbers; offsets of a sequence run from 0 without gaps. An
    empty table gives no rows.
    """
    total = items.count()
    groups = max(1, -(-total // group_pieces))
    # By place, not by value, so that rows repeated any number of times are spread too.
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    waiting = items.withColumn("group", spread)
    done: list[DataFrame] = []
    while True:
        most = max(capacity, group_pieces // 2) if groups > 1 else 0
        result = kept(
            waiting.withColumn("round", F.lit(len(done)))
            .groupBy("group")
            .applyInArrow(_pack_group(capacity, most), PIECES + ", group long, sequence_id long, offset long, again boolean"),
            "packed",
        )
        done.append(result.where("NOT again").drop("group", "again"))
        open_ = result.where("again").select("doc_id", "piece", "start", "length", "ids_crc32", "group")
        left = open_.count() if groups > 1 else 0
        if not left:
            break
        groups = min(-(-groups // 2), max(-(-groups // FAN_IN), -(-left // group_pieces)))
        waiting = open_.withColumn("group", F.pmod(F.col("group"), F.lit(groups)))
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    docs = read_table(spark, sf_dir, "documents")
    return packed(kept(pieces(docs, public_path("word_bpe_49k.json")), "pieces"))
