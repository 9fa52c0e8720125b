"""Language-model scores by deleted interpolation.

A token's probability is a mixture of maximum-likelihood estimates of all orders, from
the uniform one up to the longest context that training has seen. The mixture's weights
depend on how often that context was seen, by powers of two. They are learned by
expectation-maximisation on a fold of the training documents, with estimates from
counts that have that fold deleted.

Counting goes level by level, words first:

* **Blocks** of about a million tokens, stored once as numbers into the block's own
  vocabulary, in a table bucketed by block.
* Each level's distinct n-grams of a block, with their counts there, go to buckets dealt
  by a hash of the n-gram. A bucket adds up all blocks' counts and answers each block with
  the totals and a number for every n-gram. An n-gram of the next level is the pair of
  the numbers of all its words but the last, and of the last, so no n-gram is ever taken for
  another. Frequent words have small numbers, most of whose high bytes are zero.
* An n-gram that no other block has needs no question about what extends it: the block
  has those counts itself. Most rare n-grams stop there, with one bit as their answer.
* What blocks ask about their words is a part of the table of its own, which goes as soon as it
  is answered.
* Answers move to their block once, into a table bucketed by block like the blocks; all
  later steps read both side by side.

An n-gram is one entry per block however often it occurs, so a frequent one is no hot
spot, and what is gathered grows with the distinct n-grams of the corpus.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import deleted, new_path
from .planes import from_planes, grow, rising_from_planes, rising_to_planes, shrink, to_planes
from .tables import column, fold, kept, read_table, shuffle_partitions, shuffles_cleared
from .workers import forget

ORDER = 3
BLOCK_CHARS = 6 << 20  #: a block is closed by the first document that brings it to this many
BUCKET_KEYS = 2 << 20  #: words of all text to one bucket, about; a block has an entry per bucket, so few are better
FOLDS = 10  #: of the training documents, one in so many is held out for the weights
PRIOR = 0.5  #: occurrences that each weight has from the start; keeps every weight above 0
ROUNDS = 30  #: of expectation-maximisation, at most
ENOUGH = 1e-6  #: gain in log-likelihood, as a share of it, at which the rounds end
FREQUENCIES = 40  #: classes of context frequency, by powers of two

BLOCK = (
    "block long, part string, doc_ids array<long>, roles binary, sizes binary, tokens binary, frequent binary, n_words int,"
    " asks array<struct<bucket:long,n:int,left:binary,right:binary,train:binary,held:binary>>"
)
ASKED = "block long, bucket long, n int, left binary, right binary, train binary, held binary"
REPLIES = "block long, level int, bucket long, types long, n int, alone binary, train binary, held binary, number binary"
REPLIED = ("level", "bucket", "n", "alone", "train", "held", "number")
TOKENS, WORDS = "tokens", "words"  #: parts of the table of blocks: the texts, and what is asked about their words
TRAIN, HELD, OUT = 0, 1, 2  #: a document's role: counted, counted and held out for the weights, only scored


def _arrow(schema: str) -> pa.Schema:
    """Of the few Spark types used here."""
    plain = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, plain[kind]) for name, kind in (field.split() for field in schema.split(", "))])


_ASK = _arrow("bucket long, n int, left binary, right binary, train binary, held binary")
_ASKED, _REPLIES = _arrow(ASKED), _arrow(REPLIES)
_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("part", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("roles", pa.binary()),
        ("sizes", pa.binary()),
        ("tokens", pa.binary()),
        ("frequent", pa.binary()),
        ("n_words", pa.int32()),
        ("asks", pa.list_(pa.struct(list(_ASK)))),
    ]
)


# Blocks ------------------------------------------------------------------------


def _binary(lengths: np.ndarray, data: np.ndarray) -> pa.BinaryArray:
    """Values of these lengths, one after the other in ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def tokens_of(texts: list[str | None]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All texts' tokens in a row, and how many each text has.

    A token is a run of bytes other than the blank and those from tab to carriage return,
    A-Z lower-cased; the empty word ends each text.
    """
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    change = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = change[::2], change[1::2]  # a text's own line end closes its last word
    before = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
    return _binary(np.insert(ends - starts, before, 0), data[inside]), np.diff(before, prepend=0) + 1


def _joined(words: pa.BinaryArray, edges: list[int]) -> list[bytes]:
    """The words between each two edges, as lines."""
    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words)
    return pc.binary_join(lists, pa.scalar(b"\n")).to_pylist()


def _lines(parts: list[bytes]) -> pa.BinaryArray:
    """The lines of all ``parts``."""
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    line_end = data == 10
    return _binary(np.diff(np.flatnonzero(line_end), prepend=-1) - 1, data[~line_end])


def _counts_by_role(codes: np.ndarray, roles: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per code its occurrences in training documents, and those of them in the fold."""
    counts = np.bincount(codes * 3 + roles, minlength=3 * size).reshape(-1, 3)
    return counts[:, TRAIN] + counts[:, HELD], counts[:, HELD]


def _stretches(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each stretch of equal numbers."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return list(zip(edges, [*edges, len(bucket)][1:], strict=True))


def _order(*columns: np.ndarray) -> np.ndarray:
    """The order by all columns of numbers, the first one first."""
    widths = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(widths) > 64:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.uint64)
    for column_, width in zip(columns[1:], widths[1:], strict=True):
        key = (key << np.uint64(width)) | column_.astype(np.uint64)
    return np.argsort(key)


def _block_rows(number: int, docs: list, roles: list, texts: list, buckets: int) -> pa.RecordBatch:
    """Tokens as places in the block's vocabulary, which is sorted by bucket and word.

    They are stored as ranks by frequency, most of whose high bytes are zero.
    """
    words, sizes = tokens_of(texts)
    coded = words.dictionary_encode()
    by_word = pc.sort_indices(coded.dictionary)
    spelled = coded.dictionary.take(by_word)
    bucket = np.array([zlib.crc32(w) % buckets for w in _joined(spelled, [0, len(spelled)])[0].split(b"\n")], np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    rank = np.empty(len(spelled), np.int64)
    rank[by_word.to_numpy()[by_bucket]] = np.arange(len(spelled))
    tokens = rank[coded.indices.to_numpy()]
    train, held = _counts_by_role(tokens, np.repeat(np.array(roles, np.int64), sizes), len(spelled))
    stretches = _stretches(bucket[by_bucket])
    parts = _joined(spelled.take(pa.array(by_bucket)), [0, *(b for _, b in stretches)])
    asks = []
    for (a, b), text in zip(stretches, parts, strict=True):
        counted = (to_planes(x[a:b].astype("<u4")) for x in (train, held))
        asks.append(dict(zip(_ASK.names, (int(bucket[by_bucket[a]]), b - a, shrink(text), b"", *counted), strict=True)))
    frequent = np.argsort(-np.bincount(tokens, minlength=len(spelled)), kind="stable")
    by_rank = np.empty(len(spelled), np.int64)
    by_rank[frequent] = np.arange(len(spelled))
    packed = (to_planes(x.astype("<u4")) for x in (sizes, by_rank[tokens], frequent))
    rows = [(number, TOKENS, docs, bytes(roles), *packed, len(spelled), None), (number, WORDS, *[None] * 6, asks)]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)


def _into_blocks(block_chars: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        number, docs, roles, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for doc, role, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                docs.append(doc.as_py())
                roles.append(role.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "") + 1
                if size >= block_chars:
                    yield _block_rows(number, docs, roles, texts, buckets)
                    number, docs, roles, texts, size = number + 1, [], [], [], 0
        if docs:
            yield _block_rows(number, docs, roles, texts, buckets)

    return run


@dataclass
class _Level:
    """The distinct n-grams of one length in a block, with their totals in the whole training text."""

    codes: np.ndarray  #: per place of the block (documents with their beginnings); -1 where there is none
    ends: np.ndarray  #: each n-gram's last word
    train: np.ndarray
    held: np.ndarray
    number: np.ndarray
    settled: np.ndarray  #: no other block has it


@dataclass
class _Asked:
    """A level before its answers: own counts, and which n-grams to ask about, in the order of the questions."""

    codes: np.ndarray
    ends: np.ndarray
    train: np.ndarray
    held: np.ndarray
    order: np.ndarray
    bucket: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def rows(self, block: int) -> pa.Table:
        out = []
        for a, b in _stretches(self.bucket):
            of = self.order[a:b]
            sides = rising_to_planes(self.left[a:b]), to_planes(self.right[a:b])
            counted = (to_planes(x[of].astype("<u4")) for x in (self.train, self.held))
            out.append((block, int(self.bucket[a]), b - a, *sides, *counted))
        columns = list(zip(*out, strict=True)) or [()] * len(_ASKED)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ASKED, strict=True)], schema=_ASKED)

    def answered(self, replies: list, buckets: int, rising: bool = True) -> _Level:
        """``replies``: per bucket how many n-grams were asked about, which no other block has, and what the rest got.

        An n-gram's number is made of its place in its bucket (``rising`` in the order of the questions) and the bucket.
        """
        train, held, number = self.train.astype(np.int64), self.held.astype(np.int64), np.zeros(len(self.train), np.uint64)
        settled, at = np.ones(len(self.train), bool), 0
        for bucket, (n, alone, *totals) in sorted(replies, key=lambda reply: reply[0]):
            own = np.unpackbits(np.frombuffer(alone, np.uint8), count=n).astype(bool)
            shared = self.order[at : at + n][~own]
            settled[shared] = False
            train[shared], held[shared] = (from_planes(x, "<i8") for x in totals[:2])
            if totals[2]:
                place = rising_from_planes(totals[2]) if rising else from_planes(totals[2], "<u8")
                number[shared] = place * np.uint64(buckets) + np.uint64(bucket + 1)
            at += n
        return _Level(self.codes, self.ends, train, held, number, settled)


class _Block:
    """A block's tokens, each document with a beginning before it, and the levels answered so far."""

    def __init__(self, row: pa.Table, replies: pa.Table, answered: int, begun: tuple[int, int], buckets: int):
        first = {c: row.column(c)[0].as_py() for c in ("block", "doc_ids", "roles", "sizes", "tokens", "frequent", "n_words")}
        self.number, self.docs, self.buckets = first["block"], first["doc_ids"], buckets
        self.roles = np.frombuffer(first["roles"], np.uint8)
        self.sizes = from_planes(first["sizes"], "<u4").astype(np.int64)
        words = first["n_words"]
        starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        seq = np.empty(int(self.sizes.sum()) + len(starts), np.int64)
        self.place = np.arange(len(seq)) - np.repeat(starts, self.sizes + 1)
        tokens = from_planes(first["frequent"], "<u4").astype(np.int64)[from_planes(first["tokens"], "<u4")]
        seq[self.place > 0] = tokens
        seq[self.place == 0] = words
        self.doc = np.repeat(np.arange(len(starts)), self.sizes + 1)
        self.role = self.roles.astype(np.int64)[self.doc]
        self.levels: list[_Level] = []
        told: dict[int, list] = {level: [] for level in range(1, answered + 1)}
        for level, bucket, *data in zip(*(replies.column(c).to_pylist() for c in REPLIED), strict=True):
            told[level].append((bucket, data))
        if answered:
            own = _counts_by_role(tokens, self.role[self.place > 0], words)
            none = np.zeros(0, np.uint64)
            level = _Asked(seq, np.arange(words + 1, dtype=np.int32), *own, np.arange(words), none, none, none).answered(told[1], buckets, rising=False)
            beginning = (*begun, np.uint64(0), False)  # number 0, counted once a document
            totals = (level.train, level.held, level.number, level.settled)
            self.levels.append(_Level(seq, level.ends, *(np.append(x, y) for x, y in zip(totals, beginning, strict=True))))
        for level in range(2, answered + 1):
            self.levels.append(self.next_level().answered(told[level], buckets))

    def next_level(self) -> _Asked:
        """The pairs of neighbouring n-grams of the last level, as the first one and the last word."""
        last = self.levels[-1]
        there = self.place[1:] >= len(self.levels)
        size = len(last.train)
        pairs, distinct = pd.factorize((last.codes[:-1] * size + last.codes[1:])[there])
        codes = np.full(len(self.place), -1, np.int64)
        codes[1:][there] = pairs
        train, held = _counts_by_role(pairs, self.role[1:][there], len(distinct))
        left = distinct // max(1, size)
        right = distinct - left * size
        open_ = np.flatnonzero(~(last.settled[left] | last.settled[right]))
        ends = last.ends[right]
        a, b = last.number[left[open_]], self.levels[0].number[ends[open_]]
        bucket = _bucket(a, b, self.buckets)
        order = _order(bucket, a, b)
        return _Asked(codes, ends, train, held, open_[order], bucket[order], a[order], b[order])

    def estimates(self, deleted: bool, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of tokens, each one's class of context and its estimates of order 1 and up (0 where unseen).

        ``deleted`` takes the fold's occurrences out of all counts, and only its tokens are
        looked at; ``tokens`` is the number of training tokens that counts are taken of.
        """
        at = np.flatnonzero((self.place > 0) & (self.role == HELD) if deleted else self.place > 0)
        share = np.zeros((len(self.levels), len(at)))
        kind = np.zeros(len(at), np.int64)
        for k, level in enumerate(self.levels):
            counts = level.train - level.held if deleted else level.train
            if not len(counts):  # no text of the block is that long
                continue
            seen = counts[level.codes[at]]
            if k == 0:
                share[0] = seen / max(1, tokens)
                continue
            shorter = self.levels[k - 1]
            total = shorter.train - shorter.held if deleted else shorter.train
            context = np.where(self.place[at] > k - 1, total[shorter.codes[at - 1]], 0)
            there = context > 0
            np.divide(seen, context, out=share[k], where=there)
            # frexp gives the power of two above: 1 for 1, 2 for 2 and 3, 3 for 4 to 7
            power = np.minimum(np.frexp(context.astype(np.float64))[1] - 1, FREQUENCIES - 1)
            kind = np.where(there, k * FREQUENCIES + power, kind)
        return at, kind, share


def _bucket(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    value = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F))
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return (value >> np.uint64(33)).astype(np.int64) % buckets


# Buckets -----------------------------------------------------------------------


def _answer(level: int, last: bool):
    """Adds up the blocks' counts of a bucket's n-grams.

    Each block gets the totals of those that another block has too, and their places in the bucket unless this level is the ``last``.
    """

    told_places = to_planes if level == 1 else rising_to_planes

    def run(table: pa.Table) -> pa.Table:
        forget()
        bucket, sizes = table.column("bucket")[0].as_py(), table.column("n").to_pylist()
        if level == 1:
            coded = _lines([grow(x) for x in table.column("left").to_pylist()]).dictionary_encode()
            group, size = coded.indices.to_numpy(), len(coded.dictionary)
        else:
            left = np.concatenate([rising_from_planes(x) for x in table.column("left").to_pylist()])
            right = np.concatenate([from_planes(x, "<u8") for x in table.column("right").to_pylist()])
            sort = _order(left, right)
            a, b = left[sort], right[sort]
            fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            group = np.empty(len(sort), np.int64)
            group[sort] = np.cumsum(fresh) - 1
            size = int(fresh.sum())
        totals = []
        for name in ("train", "held"):
            own = np.concatenate([from_planes(x, "<u4") for x in table.column(name).to_pylist()])
            totals.append(np.bincount(group, own, size).astype(np.int64))
        place = np.arange(size, dtype=np.uint64)
        if level == 1:  # words by falling frequency; n-grams are in the order of the questions, as they are
            place[np.argsort(-totals[0], kind="stable")] = np.arange(size, dtype=np.uint64)
        known, alone = int((totals[0] > 0).sum()), np.bincount(group, minlength=size) == 1
        out, at = [], 0
        for k, (block, n) in enumerate(zip(table.column("block").to_pylist(), sizes, strict=True)):
            of = group[at : at + n]
            own = alone[of]
            shared = of[~own]
            told = (to_planes(totals[0][shared]), to_planes(totals[1][shared]), b"" if last else told_places(place[shared]))
            out.append((block, level, bucket, 0 if k else known, n, np.packbits(own).tobytes(), *told))
            at += n
        columns = zip(*out, strict=True)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _REPLIES, strict=True)], schema=_REPLIES)

    return run


# Weights -----------------------------------------------------------------------


def classes(order: int) -> np.ndarray:
    """Uniform weights of all classes of context, a column per order from 0 on."""
    weights = np.zeros((order * FREQUENCIES, order + 1))
    for kind in range(len(weights)):
        usable = max(1, kind // FREQUENCIES + 1) + 1
        weights[kind, :usable] = 1 / usable
    return weights


def expectation(weights: np.ndarray, kind: np.ndarray, share: np.ndarray, uniform: float) -> tuple[np.ndarray, float]:
    """Per class and order how many tokens it accounts for, and the natural log-likelihood."""
    parts = np.vstack([np.full(share.shape[1], uniform), share]) * weights[kind].T
    total = parts.sum(axis=0)
    gains = np.stack([np.bincount(kind, p / total, len(weights)) for p in parts], axis=1)
    return gains, float(np.log(total).sum())


def improved(weights: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The weights that explain ``gains`` best, with a prior on those in use."""
    mass = np.where(weights > 0, gains + PRIOR, 0)
    return mass / mass.sum(axis=1, keepdims=True)


def _learned(rows: DataFrame, order: int, uniform: float) -> np.ndarray:
    """Weights by expectation-maximisation; each round is one pass over the fold's tokens."""
    weights, before = classes(order), -math.inf
    for _ in range(ROUNDS):

        def step(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            gains, likelihood = np.zeros_like(weights), 0.0
            for batch in batches:
                for kind, share in zip(batch.column("kind").to_pylist(), batch.column("share").to_pylist(), strict=True):
                    kinds = from_planes(kind, "<i8")
                    found, more = expectation(weights, kinds, from_planes(share, "<f8").reshape(order, -1), uniform)
                    gains, likelihood = gains + found, likelihood + more
            where, k = np.nonzero(gains)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*where.tolist(), -1], pa.int32()),
                    pa.array([*k.tolist(), 0], pa.int32()),
                    pa.array([*gains[where, k].tolist(), likelihood], pa.float64()),
                ],
                names=["kind", "k", "gain"],
            )

        found = rows.mapInArrow(step, "kind int, k int, gain double").groupBy("kind", "k").agg(F.sum("gain").alias("gain"))
        gains, likelihood = np.zeros_like(weights), 0.0
        for r in found.collect():  # at most one number per class and order
            if r.kind < 0:
                likelihood = r.gain
            else:
                gains[r.kind, r.k] = r.gain
        weights = improved(weights, gains)
        if likelihood - before <= ENOUGH * abs(likelihood):
            break
        before = likelihood
    return weights


# The operator ------------------------------------------------------------------


def _per_doc(block: _Block, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.bincount(block.doc[at], values, len(block.docs))


def scored(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 10,
    order: int = ORDER,
    block_chars: int = BLOCK_CHARS,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text is 0 modulo ``folds`` are only scored; the model
    learns from all others. Tokens are lower-cased (A-Z) words and one end per text.
    base_score is the sum of log10 of the smoothed word shares, ``score`` that of the
    mixture of n-grams up to ``order`` words. A NULL or empty text is its end alone.
    Repeated rows are counted and scored each; the id NULL counts as the empty text in the
    crc32. Without any training row all scores are 0: there is one class, the unknown word.
    An empty table gives no rows. Other columns are not read.
    """
    if order < 1:
        raise ValueError("order must be 1 at least")
    spark = docs.sparkSession
    crc = F.crc32(F.encode(F.coalesce(column(id_col).cast("string"), F.lit("")), "utf-8"))
    role = (
        F.when(fold(column(id_col), folds) == 0, OUT)
        .when(F.floor(crc / folds) % FOLDS == 0, HELD)
        .otherwise(TRAIN)
        .cast("int")
    )
    rows = docs.select(column(id_col).cast("long").alias("id"), role.alias("role"), column(text_col).alias("text"))
    # Blanks in ASCII never fall into another character, so this is the number of words up to neighbours.
    about = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(about / 6 / bucket_keys))

    name, replies = (f"spokeframe_{kind}_{uuid.uuid4().hex}" for kind in ("blocks", "replies"))
    path = new_path(spark, "lm-blocks")
    (
        rows.mapInArrow(_into_blocks(block_chars, buckets), BLOCK)
        .write.partitionBy("part")
        .bucketBy(shuffle_partitions(spark), "block")
        .option("compression", "none")  # its columns are packed already
        .option("path", path)
        .saveAsTable(name)
    )
    try:
        with shuffles_cleared(spark):
            return _scored(spark.table(name), path, replies, order, buckets)
    finally:
        for table in (name, replies):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def _scored(blocks: DataFrame, stored: str, name: str, order: int, buckets: int) -> DataFrame:
    """``stored`` is where the blocks are, ``name`` that of the table of answers, to be made here."""
    spark = blocks.sparkSession
    table = blocks.where(F.col("part") == TOKENS)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for role, size in zip(batch.column("roles").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                roles, tokens = np.frombuffer(role, np.uint8), from_planes(size, "<u4").astype(np.int64)
                kinds = [roles != OUT, roles == HELD]
                found = [int(x) for k in kinds for x in (k.sum(), tokens[k].sum())]
                yield pa.RecordBatch.from_pydict({c: [x] for c, x in zip("abcd", found, strict=True)})

    total = table.select("roles", "sizes").mapInArrow(sizes, "a long, b long, c long, d long")
    n_docs, n_tokens, held_docs, held_tokens = (x or 0 for x in total.agg(*(F.sum(c) for c in "abcd")).first())
    begun = (n_docs, held_docs)
    read = table.select("block", "doc_ids", "roles", "sizes", "tokens", "frequent", "n_words")

    def with_blocks(replies: DataFrame, answered: int, work, schema: str) -> DataFrame:
        def run(rows: pa.Table, told: pa.Table) -> pa.Table:
            forget()
            return work(_Block(rows, told, answered, begun, buckets))

        return read.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)

    words = blocks.where(F.col("part") == WORDS).select("block", F.explode("asks").alias("ask")).select("block", "ask.*")
    tasks, path = shuffle_partitions(spark), new_path(spark, "lm-replies")
    for level in range(1, order + 1):
        asked = words
        if level > 1:
            asked = with_blocks(spark.table(name), level - 1, lambda b: b.next_level().rows(b.number), ASKED)
        found = asked.groupBy("bucket").applyInArrow(_answer(level, level == order), REPLIES)
        # The questions' shuffle files go before the answers move.
        moved = new_path(spark, "lm-answers")
        found.write.option("compression", "none").parquet(moved)
        # One file per bucket and level; what was answered before is not written again.
        found = spark.read.schema(REPLIES).parquet(moved)
        writer = found.repartition(tasks, "block").write.mode("append").option("compression", "none")
        writer.bucketBy(tasks, "block").option("path", path).saveAsTable(name)
        deleted(spark, moved)
        if level == 1:
            types = spark.table(name).agg(F.sum("types")).first()[0] or 0
            deleted(spark, f"{stored}/part={WORDS}")
    replies = spark.table(name)

    def fold_tokens(block: _Block) -> pa.Table:
        _, kind, share = block.estimates(True, n_tokens - held_tokens)
        return pa.table({"kind": pa.array([to_planes(kind)], pa.binary()), "share": pa.array([to_planes(share.reshape(-1))], pa.binary())})

    uniform = 1 / (types + 1)
    weights = classes(order)
    if held_tokens:
        weights = _learned(kept(with_blocks(replies, order, fold_tokens, "kind binary, share binary"), "lm-fold"), order, uniform)

    def scores(block: _Block) -> pa.Table:
        at, kind, share = block.estimates(False, n_tokens)
        mixed = uniform * weights[kind, 0]
        for k in range(order):
            mixed += weights[kind, k + 1] * share[k]
        seen = block.levels[0].train[block.levels[0].codes[at]]
        base = np.log10((seen + 0.1) / (n_tokens + 0.1 * (types + 1)))
        return pa.table(
            {
                "doc_id": pa.array(block.docs, pa.int64()),
                "held_out": pa.array((block.roles == OUT).tolist(), pa.bool_()),
                "n_tokens": pa.array(block.sizes, pa.int64()),
                "n_known": pa.array(_per_doc(block, at, seen > 0).astype(np.int64), pa.int64()),
                "train_tokens": pa.array(np.full(len(block.docs), n_tokens), pa.int64()),
                "base_score": pa.array(_per_doc(block, at, base), pa.float64()),
                "score": pa.array(_per_doc(block, at, np.log10(mixed)), pa.float64()),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return kept(with_blocks(replies, order, scores, schema), "lm-scores")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents by a mixture of n-grams."""
    return scored(read_table(spark, sf_dir, "documents"))
