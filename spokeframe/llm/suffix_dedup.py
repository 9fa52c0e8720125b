"""Removal of repeated passages by blockwise suffix grouping with a difference cover.

Two suffixes matter to each other only if their first ``window`` bytes agree, so the
order of suffixes is needed no deeper than that, and only as classes of equal ones.

* **Parts.** Documents in id order are cut into parts of some megabytes, a table
  bucketed by part: later steps read it where it lies, only their small answers move.
  A document equal to an earlier one is settled at once and does not take part again.
* **Cover sample.** Positions whose offset in the document falls into a difference
  cover modulo 57 (8 of 57). For any two offsets there is a shift below 57 that brings
  both into the cover, so two equal windows of 100 bytes hold, at that shift, equal
  sampled stretches of 44 bytes. The sample's stretches are ranked as repeated or not,
  one bucket at a time; only windows that reach a repeated one within 57 bytes go on.
* **Suffix buckets.** The fingerprints of those windows are dealt to buckets by their
  leading bits and sorted one bucket at a time. A bucket's answer to a part is one bit
  per distinct fingerprint: whether an earlier part has it. Within a part the first
  occurrence stays.
* Each part then marks the bytes its repeated windows cover.

A fingerprint in a part counts once however often it occurs there, so a line that
stands in every document is one entry per part. Buckets are bounded by the number of
distinct fingerprints, which Spark spreads evenly. A window's fingerprint has 128 bits,
two independent ones of 64: with n windows that go on, the chance of any false match is
about n**2 / 2**129 (see the README for windows that are rearrangements of each other).
The sample's keys are one fingerprint, shortened.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import new_path
from .bitpack import pack, unpack
from .tables import column, kept, read_table, shuffle_partitions
from .workers import forget, remembered

WINDOW = 100
#: A perfect difference set: every residue modulo 57 but 0 is the difference of one pair.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
PART_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20  #: distinct fingerprints of a bucket, about
BLOCK = 1 << 20  #: positions fingerprinted at once
SAMPLE_SLACK_BITS = 13  #: beyond the logarithm of the input; a false rank only sends a window on

#: Of the two fingerprints: an odd base, and what each byte stands for (any 64 bits, so that no bit of a sum is fixed).
_BASE = (0x9E3779B97F4A7C13, 0xD1342543DE82EF95)
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
REPLIES = "part long, kind int, bucket long, n long, data binary"
ASKED = "part long, bucket long, n long, first binary, width int, data binary, second binary"


@remembered(maxsize=4)
def _powers(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.full(size, pow(_BASE[which], -1, 1 << 64), np.uint64)
    inverse[0] = 1
    forward = np.full(size, _BASE[which], np.uint64)
    forward[0] = 1
    return np.cumprod(inverse), np.cumprod(forward)


def fingerprints(data: np.ndarray, length: int, places: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit fingerprint, one of two, of the ``length`` bytes at each of the sorted ``places``."""
    out = np.empty(len(places), np.uint64)
    inverse, forward = _powers(BLOCK + length, which)
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        a, b = np.searchsorted(places, (at, at + BLOCK)).tolist()
        if a == b:
            continue
        here = places[a:b] - at
        terms = _BYTE[which][data[at : at + BLOCK + length - 1]]
        terms *= inverse[: len(terms)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        value = (sums[here + length] - sums[here]) * forward[here]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        out[a:b] = value
    return out


def _order(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of pairs, and which of them in that order equal the pair before; or so of ``first`` alone."""
    order = np.argsort(first, kind="stable")
    a = first[order]
    same = a[1:] == a[:-1]
    if second is None:
        return order, np.concatenate([np.zeros(min(1, len(first)), bool), same])
    b = second[order]
    other = b[1:] != b[:-1]
    if (same & other).any():  # one first fingerprint with two second ones
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        same = a[1:] == a[:-1]
        other = b[1:] != b[:-1]
    return order, np.concatenate([np.zeros(min(1, len(first)), bool), same & ~other])


class _Part:
    """The bytes of a part's documents, and which windows of them go on."""

    def __init__(self, rows: pa.Table, replies: pa.Table, settings: dict):
        self.rows = rows.sort_by("seq")
        self.settings = settings
        self.texts = [t.as_py() for t in self.rows.column("text")]
        copies: set[int] = set()
        self.bits: dict[int, np.ndarray] = {}
        by_kind: dict[int, list] = {}
        for kind, bucket, n, data in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "n", "data")), strict=True):
            if kind == 0:
                copies.update(np.frombuffer(data, np.int32).tolist())
            else:
                by_kind.setdefault(kind, []).append((bucket, n, data))
        for kind, found in by_kind.items():
            found.sort()
            bits = [np.unpackbits(np.frombuffer(d, np.uint8), count=n).astype(bool) for _, n, d in found]
            self.bits[kind] = np.concatenate(bits)
        self.copy = np.array([s in copies for s in self.rows.column("seq").to_pylist()], bool)
        raw = [b"" if c or t is None else t.encode() for t, c in zip(self.texts, self.copy, strict=True)]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)

    def _inside(self, length: int) -> np.ndarray:
        """Places whose next ``length`` bytes belong to one document."""
        ok = np.ones(max(0, len(self.data) - length + 1), bool)
        for edge in self.edges[1:-1].tolist():
            ok[max(0, edge - length + 1) : edge] = False
        return ok

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places and the keys of the stretches there."""
        length = self.settings["window"] - PERIOD + 1
        in_cover = np.zeros(PERIOD, bool)
        in_cover[list(COVER)] = True
        chosen = self._inside(length)
        for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True):
            b = min(b, len(chosen))
            if a < b:
                chosen[a:b] &= np.resize(in_cover, b - a)
        places = np.flatnonzero(chosen)
        keys = fingerprints(self.data, length, places) >> np.uint64(64 - self.settings["sample_bits"])
        return places, keys

    def going_on(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that reach a repeated stretch of the sample, and their two fingerprints."""
        window = self.settings["window"]
        places, keys = self.sample()
        distinct, where, count = np.unique(keys, return_inverse=True, return_counts=True)
        repeated = count > 1
        if 1 in self.bits:
            repeated |= self.bits[1]
        hits = places[repeated[where]]
        ok = self._inside(window)
        reach = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(reach, np.maximum(hits - PERIOD + 1, 0), 1)
        np.add.at(reach, hits + 1, -1)
        candidates = np.flatnonzero((np.cumsum(reach[: len(ok)]) > 0) & ok)
        return candidates, *(fingerprints(self.data, window, candidates, which) for which in (0, 1))

    def repeated_starts(self) -> np.ndarray:
        """Windows whose bytes also start earlier."""
        places, first, second = self.going_on()
        order, repeated = _order(first, second)
        if 2 in self.bits:
            repeated[~repeated] = self.bits[2]
        return places[order[repeated]]


def _ask(part: int, keys: np.ndarray, key_bits: int, buckets: int, second: np.ndarray | None = None) -> pa.Table:
    """Distinct sorted keys as rows per bucket: the first key, then packed differences; second fingerprints as they are."""
    shift = np.uint64(key_bits - int(math.log2(buckets)))
    bucket = (keys >> shift).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, int)
    ends = np.append(edges, len(keys))[1:]
    out: dict[str, list] = {c: [] for c in ("part", "bucket", "n", "first", "width", "data", "second")}
    for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
        steps = np.diff(keys[a:b])
        width = max(1, int(steps.max()).bit_length()) if len(steps) else 1
        rest = None if second is None else second[a:b].tobytes()
        row = (part, int(bucket[a]), b - a, keys[a : a + 1].tobytes(), width, pack(steps, width), rest)
        for c, v in zip(out, row, strict=True):
            out[c].append(v)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})


def _wide(packed: bytes, width: int, count: int) -> np.ndarray:
    if width <= 32:
        return unpack(packed, width, 0, count).astype(np.uint64)
    half = width - 32
    bit = np.arange(count, dtype=np.uint64) * np.uint64(width)
    words = np.frombuffer(packed + bytes(16 - len(packed) % 8), "<u8")
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    value = words[word] >> shift
    spill = shift + np.uint64(width) > np.uint64(64)
    value[spill] |= words[word[spill] + 1] << (np.uint64(64) - shift[spill])
    return value & np.uint64((1 << (half + 32)) - 1)


def _answer(kind: int):
    """One bit per key asked about: kind 1, another part has it; kind 2, an earlier part has it."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        table = table.sort_by("part")
        asked = []
        for n, first, width, data in zip(*(table.column(c).to_pylist() for c in ("n", "first", "width", "data")), strict=True):
            keys = np.empty(n, np.uint64)
            keys[0] = np.frombuffer(first, np.uint64)[0]
            keys[1:] = _wide(data, width, n - 1)
            asked.append(np.cumsum(keys, dtype=np.uint64))
        sizes = [len(k) for k in asked]
        keys = np.concatenate(asked)
        del asked
        second = None
        if kind == 2:
            second = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table.column("second")])
        order, equal = _order(keys, second)  # equal keys stay in the order of their parts
        count = len(keys)
        del keys, second
        same = np.append(equal, False)
        flag = np.empty(count, bool)
        flag[order] = same[:-1] | same[1:] if kind == 1 else same[:-1]
        parts = np.split(flag, np.cumsum(sizes)[:-1])
        return pa.table(
            {
                "part": table.column("part"),
                "kind": pa.array([kind] * len(sizes), pa.int32()),
                "bucket": table.column("bucket"),
                "n": table.column("n"),
                "data": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
            }
        )

    return run


def _cut_into_parts(part_bytes: int, window: int):
    """Adds part, seq and the digest of texts long enough to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shard = TaskContext.get().partitionId()
        part = seq = size = 0
        for batch in batches:
            parts, seqs, digests = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                raw = (text.as_py() or "").encode()
                if size and size + len(raw) > part_bytes:
                    part, seq, size = part + 1, 0, 0
                parts.append((shard << 32) + part)
                seqs.append(seq)
                digests.append(hashlib.blake2b(raw, digest_size=16).digest() if len(raw) >= window else None)
                seq, size = seq + 1, size + len(raw)
            added = [pa.array(parts, pa.int64()), pa.array(seqs, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "part", "seq", "digest"])

    return run


def _parts_table(docs: DataFrame, id_col: str, text_col: str, part_bytes: int, window: int) -> DataFrame:
    """Documents in id order with their part, bucketed by part."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    others = [column(c) for c in docs.columns if c != text_col]
    rows = docs.select(
        column(id_col).cast("long").alias("id"),
        F.struct(*others).alias("rest"),
        column(text_col).alias("text"),
    )
    schema = rows.select(
        "*", F.lit(0).cast("long").alias("part"), F.lit(0).alias("seq"), F.lit(None).cast("binary").alias("digest")
    ).schema
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    name = f"spokeframe_parts_{uuid.uuid4().hex}"
    (
        ordered.mapInArrow(_cut_into_parts(part_bytes, window), schema)
        .write.bucketBy(n, "part")
        .sortBy("part", "seq")
        .option("compression", "zstd")
        .option("path", new_path(spark, "parts"))
        .saveAsTable(name)
    )
    return spark.table(name)


def _copies(parts: DataFrame) -> DataFrame:
    """Per part the documents equal to an earlier one, as packed numbers."""
    rows = kept(parts.where("digest IS NOT NULL").select("digest", "part", "seq"), "digests")
    first = rows.groupBy("digest").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(first, "digest").where("part <> first.part OR seq <> first.seq")

    def packed(table: pa.Table) -> pa.Table:
        numbers = table.column("seq").to_numpy().astype(np.int32)
        return pa.table(
            {
                "part": table.column("part")[:1],
                "kind": pa.array([0], pa.int32()),
                "bucket": pa.array([0], pa.int64()),
                "n": pa.array([len(numbers)], pa.int64()),
                "data": pa.array([numbers.tobytes()], pa.binary()),
            }
        )

    return kept(later.select("part", "seq").groupBy("part").applyInArrow(packed, REPLIES), "copies")


def _power_of_two(at_least: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, at_least))))


def repeated_removed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    part_bytes: int = PART_BYTES,
    texts: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, rest (its other columns), text, spans, n_bytes, kept_bytes.

    Texts are UTF-8 bytes, a NULL is empty, and matches never cross documents. ``spans``
    are the maximal runs (start, end) of bytes covered by a string of ``window`` bytes that
    also starts earlier: in a document with a smaller id, or earlier in the same one; all
    strings are judged on the input. kept_bytes are the bytes outside the spans. Rows with
    equal ids stand in the order of their texts; ids of NULL come first. Texts shorter than
    the window lose nothing. An empty table gives no rows. With ``texts`` the columns are
    rest and text alone, the text without its spans (as by :func:`without_spans`).
    """
    if window < PERIOD + 8:
        raise ValueError(f"the window must have at least {PERIOD + 8} bytes")
    spark = docs.sparkSession
    parts = _parts_table(docs, id_col, text_col, part_bytes, window)
    total = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    settings = {
        "window": window,
        "sample_bits": min(64, max(24, math.ceil(math.log2(total + 2)) + SAMPLE_SLACK_BITS)),
    }
    buckets = min(1 << 20, _power_of_two(max(16, total * len(COVER) / PERIOD / BUCKET_KEYS)))
    sample_bits = settings["sample_bits"]
    replies = _copies(parts)

    def with_parts(replies: DataFrame, work, schema) -> DataFrame:
        return parts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(work, schema)

    def ask_sample(rows: pa.Table, told: pa.Table) -> pa.Table:
        forget()
        part = _Part(rows, told, settings)
        return _ask(rows.column("part")[0].as_py(), np.unique(part.sample()[1]), sample_bits, buckets)

    asked = with_parts(replies, ask_sample, ASKED)
    repeated = kept(asked.groupBy("bucket").applyInArrow(_answer(1), REPLIES), "repeated")
    replies = replies.unionByName(repeated)

    def ask_windows(rows: pa.Table, told: pa.Table) -> pa.Table:
        forget()
        part = _Part(rows, told, settings)
        _, first, second = part.going_on()
        order, again = _order(first, second)
        order = order[~again]
        return _ask(rows.column("part")[0].as_py(), first[order], 64, buckets, second[order])

    asked = with_parts(replies, ask_windows, ASKED)
    earlier = kept(asked.groupBy("bucket").applyInArrow(_answer(2), REPLIES), "earlier")
    replies = replies.unionByName(earlier)

    def remove(rows: pa.Table, told: pa.Table) -> pa.Table:
        forget()
        part = _Part(rows, told, settings)
        starts = part.repeated_starts()
        cover = np.zeros(len(part.data) + 1, np.int32)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        del cover, starts
        spans, kept_bytes, sizes = [], [], []
        for i, (a, b) in enumerate(zip(part.edges[:-1].tolist(), part.edges[1:].tolist(), strict=True)):
            if part.copy[i]:
                size = len((part.texts[i] or "").encode())
                spans.append([(0, size)])
                kept_bytes.append(b"")
                sizes.append(size)
                continue
            here = gone[a:b]
            change = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]])))
            spans.append(list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True)))
            kept_bytes.append(part.data[a:b][~here].tobytes())
            sizes.append(b - a)
        as_rows = [[{"start": s, "end": e} for s, e in x] for x in spans]
        if texts:
            cut = [t if t is None or not s else without_spans(t.encode(), s) for t, s in zip(part.texts, as_rows, strict=True)]
            return part.rows.select(["rest"]).append_column("text", pa.array(cut, pa.string()))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return (
            part.rows.select(["id", "rest", "text"])
            .append_column("spans", pa.array(as_rows, pa.list_(span)))
            .append_column("n_bytes", pa.array(sizes, pa.int64()))
            .append_column("kept_bytes", pa.array(kept_bytes, pa.binary()))
        )

    spans = F.array().cast("array<struct<start:long,end:long>>")
    schema = parts.select(
        "id", "rest", "text", spans.alias("spans"), F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("kept_bytes")
    ).schema
    return with_parts(replies, remove, parts.select("rest", "text").schema if texts else schema)


def without_spans(raw: bytes, spans: list) -> str:
    """Text outside the spans; a character that a span cuts stays whole."""
    out, at = [], 0
    for span in spans:
        start, end = span["start"], span["end"]
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]]).decode()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages removed from the texts; every row and column stays.

    Rules as in :func:`repeated_removed`. A NULL text stays NULL. A character of which a
    span covers only a part stays, so that texts stay valid.
    """
    rows = repeated_removed(docs, id_col, text_col, window, texts=True)

    def field(name: str) -> Column:
        return F.col("text").alias(name) if name == text_col else F.col("rest").getField(name).alias(name)

    return rows.select([field(c) for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to passages of 100 bytes that also start earlier."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_removed(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
