"""Alignment of two tokenizers' tokens by interval coalescing, and corpus-wide counts of linked ids.

Tokens of both sides are intervals of bytes on one line. Sorted by start, with the running
maximum of their ends, a group begins where a start reaches that maximum; within a group
every A token is linked with every B token.

Both tokenizers end a token before a run of blanks and line ends, so a text's groups are
those of its pieces between such places, in a row. Documents are cut into pieces block by
block, and each distinct piece of a block is encoded and aligned once, all pieces laid end
to end on one line. A text for which that is not sure is a piece of its own.

A block is stored as numbers into its own pieces. Its distinct pairs of ids, with the
number of its documents that hold them linked, are added up over all blocks; the totals
go back to each block, which sums them over its documents' pieces. A pair is one row per
block, however many documents hold it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import new_path
from .planes import from_planes, to_planes
from .tables import column, kept, read_table, shuffle_partitions
from .vocabulary import BYTE_LETTERS, LONGEST, encoder, public_path
from .workers import forget, remembered

BLOCK_CHARS = 4 << 20  #: a block is closed by the first document that brings it to this many
REMEMBERED = 400_000  #: pieces that a worker remembers the B ids of


# The two sides -------------------------------------------------------------------


class SideA:
    """A byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        self.tokens = encoder(path, plain=True)
        of_letter = {letter: bytes([b]) for b, letter in BYTE_LETTERS.items()}
        of_letter.update((chr(b), bytes([b])) for b in range(256) if b not in BYTE_LETTERS)
        spelled = self.tokens.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(spelled.values(), default=-1) + 1)
        for token, number in spelled.items():
            self.bytes_of[number] = b"".join([of_letter.get(c) or c.encode() for c in token])

    def is_whole(self, text: str) -> bool:
        return self.tokens.is_whole(text)

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each as it were cut from a text."""
        return self.tokens.of_pieces(pieces)


class SideB:
    """A sentencepiece model, which puts a blank before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        spelled = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)
        ]
        #: Whether no token goes on from another character into a blank, or holds a line end.
        self.cuts = all("▁" not in p.lstrip("▁") and "\n" not in p for p in spelled) and self._cuts_by_trial()
        #: An empty text gets no blank before it, so a lone blank between pieces has its ids from here.
        self.blank = np.array([self.model.piece_to_id("▁")], "<u4").tobytes()
        self.memo: dict[str, bytes] = {" ": self.blank}
        self.older: dict[str, bytes] = {}

    def _cuts_by_trial(self) -> bool:
        """Blanks and line ends are neither joined nor dropped."""
        text = "a  b\n\n c \n  d   \n"
        return b"".join(self.bytes_of[i] for i in self.model.encode(text, num_threads=1)) == f" {text}".encode()

    def is_whole(self, text: str) -> bool:
        return not self.cuts or "▁" in text

    def encode(self, text: str) -> bytes:
        return np.array(self.model.encode(text, num_threads=1), "<u4").tobytes()

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of the text with the blank before it."""
        if len(self.memo) > REMEMBERED // 2:
            self.older, self.memo = self.memo, {" ": self.blank}
        memo, older = self.memo, self.older
        found = [memo.get(p) or older.get(p) for p in pieces]
        missing = [k for k, ids in enumerate(found) if ids is None]
        # The model's own blank stands for the one that a piece begins with; before a line end it is one token more.
        texts = [pieces[k][1:] if pieces[k][0] == " " else pieces[k] for k in missing]
        for k, ids in zip(missing, self.model.encode(texts, num_threads=1), strict=True):
            found[k] = np.array(ids if pieces[k][0] == " " else ids[1:], "<u4").tobytes()
        memo.update((p, ids) for p, ids in zip(pieces, found, strict=True) if len(p) <= LONGEST)
        return found


@remembered(maxsize=1)
def sides(path_a: str, path_b: str) -> tuple[SideA, SideB]:
    """One pair per worker process."""
    return SideA(path_a), SideB(path_b)


# Intervals -----------------------------------------------------------------------


def coalesced(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each A and each B token, and the number of groups.

    Both sides' tokens cover the same line from 0 on without gaps; given are their ends.
    """
    ends = np.concatenate([a_ends, b_ends])
    starts = np.concatenate([a_ends - np.diff(a_ends, prepend=0), b_ends - np.diff(b_ends, prepend=0)])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(a_ends)], group[len(a_ends) :], int(fresh.sum())


def expanded(a_group: np.ndarray, b_group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token of one group, as places in the two lists, in the order of A."""
    b_count = np.bincount(b_group, minlength=groups)
    times = b_count[a_group]
    a = np.repeat(np.arange(len(a_group)), times)
    first = (np.cumsum(b_count) - b_count)[a_group]
    return a, np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)


@dataclass
class Aligned:
    """Pieces, in order, with what a document's sums are made of."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    spelled: list[str]  #: the groups of each piece as text
    link_piece: np.ndarray  #: of each link, rising
    link_a: np.ndarray
    link_b: np.ndarray


def _spelled(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, groups_before: np.ndarray) -> list[str]:
    def of_groups(ids: np.ndarray, group: np.ndarray) -> pa.Array:
        edges = np.searchsorted(group, np.arange(groups_before[-1] + 1)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), pa.array(ids).cast(pa.string())), ",")

    both = pc.binary_join_element_wise(of_groups(a_ids, a_group), of_groups(b_ids, b_group), "|")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(groups_before.astype(np.int32)), both), ";").to_pylist()


def aligned(a_ids: list[bytes], b_ids: list[bytes], a_bytes: list[bytes], b_bytes: list[bytes]) -> Aligned:
    """Alignment of pieces given as packed ids; each piece's tokens spell the same bytes on both sides."""
    n_a, n_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = (np.frombuffer(b"".join(ids), "<u4").astype(np.int64) for ids in (a_ids, b_ids))
    a_ends, b_ends = (
        np.cumsum(np.array([len(x) for x in table], np.int64)[ids]) for ids, table in ((a, a_bytes), (b, b_bytes))
    )
    a_group, b_group, groups = coalesced(a_ends, b_ends)
    a_piece = np.repeat(np.arange(len(n_a)), n_a)
    # A group lies in one piece: both sides end a token where a piece ends.
    first = np.flatnonzero(np.diff(a_group, prepend=-1))
    n_groups = np.bincount(a_piece[first], minlength=len(n_a))
    before = np.concatenate([[0], np.cumsum(n_groups)])
    left, right = expanded(a_group, b_group, groups)
    return Aligned(n_a, n_b, n_groups, _spelled(a, b, a_group, b_group, before), a_piece[left], a[left], b[right])


# Blocks --------------------------------------------------------------------------

BLOCK = (
    "block long, doc_ids array<long>, n_a binary, n_b binary, n_groups binary, n_links binary, sha256 array<string>,"
    " sizes binary, codes binary, link_counts binary, links binary, pairs binary, pair_docs binary"
)
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_BLOCK = pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in BLOCK.split(", "))])
PAIR_BITS = 32  #: a pair of ids is one number: the A id, then so many bits of the B id


def _cut(texts: list[str], whole: list[bool]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pieces of all texts in a row, and how many each text has; cut before each run of blanks and line ends."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    blank = (data == 32) | (data == 10)
    starts = blank.copy()
    starts[1:] &= ~blank[:-1]
    begin = np.cumsum(sizes) - sizes
    starts[begin[sizes > 0]] = True
    for k in np.flatnonzero(whole).tolist():
        starts[begin[k] + 1 : begin[k] + sizes[k]] = False
    places = np.flatnonzero(starts)
    offsets = np.append(places, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pieces.dictionary_encode(), np.diff(np.searchsorted(places, np.append(begin, len(data))))


def _same_bytes(ids: bytes, table: list[bytes], piece: str) -> bool:
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]) == piece.encode()


def _piece_ids(a: SideA, b: SideB, pieces: list[str], whole: set[str]) -> tuple[list[bytes], list[bytes]]:
    """Ids on both sides; texts that go through the libraries whole apart from the pieces of others."""
    parts = [p for p in pieces if p not in whole]
    found = dict(zip(parts, zip(a.ids(parts), b.ids(parts), strict=True), strict=True))
    found.update((t, (a.tokens.encode(t), b.encode(t[1:]))) for t in pieces if t in whole)
    return [found[p][0] for p in pieces], [found[p][1] for p in pieces]


def _block_row(a: SideA, b: SideB, number: int, docs: list, texts: list) -> pa.RecordBatch:
    texts = [f" {t}" if t else "" for t in texts]
    whole = [bool(t) and (a.is_whole(t) or b.is_whole(t)) for t in texts]
    coded, sizes = _cut(texts, whole)
    pieces, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    a_ids, b_ids = _piece_ids(a, b, pieces, {t for t, w in zip(texts, whole, strict=True) if w})
    odd = [
        k
        for k, p in enumerate(pieces)
        if not (_same_bytes(a_ids[k], a.bytes_of, p) and _same_bytes(b_ids[k], b.bytes_of, p))
    ]
    doc = np.repeat(np.arange(len(docs)), sizes)
    if odd:  # a side that changes bytes anywhere in a text leaves the text without tokens
        without = np.zeros(len(pieces), bool)
        without[odd] = True
        off = np.zeros(len(docs), bool)
        off[doc[without[codes]]] = True
        codes, doc = codes[~off[doc]], doc[~off[doc]]
        for k in odd:
            a_ids[k] = b_ids[k] = b""
    found = aligned(a_ids, b_ids, a.bytes_of, b.bytes_of)
    sizes = np.bincount(doc, minlength=len(docs))
    link_counts = np.bincount(found.link_piece, minlength=len(pieces))

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values[codes], len(docs)).astype(np.int64)

    edges, spelled, in_order = np.cumsum(sizes), found.spelled, codes.tolist()
    digests = [
        hashlib.sha256(";".join([spelled[c] for c in in_order[end - n : end]]).encode()).hexdigest() if n else ""
        for end, n in zip(edges.tolist(), sizes.tolist(), strict=True)
    ]
    links = (found.link_a << PAIR_BITS) | found.link_b
    pairs, pair_docs = _documents_of_pairs(doc, codes, link_counts, links)
    row = {
        "block": number,
        "doc_ids": docs,
        "n_a": to_planes(per_doc(found.n_a)),
        "n_b": to_planes(per_doc(found.n_b)),
        "n_groups": to_planes(per_doc(found.n_groups)),
        "n_links": to_planes(per_doc(link_counts)),
        "sha256": digests,
        "sizes": to_planes(sizes),
        "codes": to_planes(codes.astype("<u4")),
        "link_counts": to_planes(link_counts),
        "links": to_planes(links),
        "pairs": to_planes(np.diff(pairs, prepend=0)),
        "pair_docs": to_planes(pair_docs),
    }
    return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=_BLOCK)


def _documents_of_pairs(doc: np.ndarray, codes: np.ndarray, link_counts: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct pairs, sorted, and in how many of its documents each stands."""
    distinct, where = np.unique(links, return_inverse=True)
    pieces = len(link_counts)
    in_doc = np.unique(doc * pieces + codes)  # each piece once a document
    doc, codes = in_doc // max(1, pieces), in_doc % max(1, pieces)
    times = link_counts[codes]
    first = (np.cumsum(link_counts) - link_counts)[codes]
    link = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    key = np.repeat(doc, times) * max(1, len(distinct)) + where[link]
    key.sort()
    once = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return distinct, np.bincount(once % max(1, len(distinct)), minlength=len(distinct))


def _into_blocks(path_a: str, path_b: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(sides, encoder)
        a, b = sides(path_a, path_b)
        number, docs, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                texts.append(text.as_py() or "")
                size += len(texts[-1]) + 1
                if size >= block_chars:
                    yield _block_row(a, b, number, docs, texts)
                    number, docs, texts, size = number + 1, [], [], 0
        if docs:
            yield _block_row(a, b, number, docs, texts)

    return run


# The operator --------------------------------------------------------------------

COUNTS = "block long, pair long, docs long"
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' distinct pairs as rows."""
    for batch in batches:
        for block, pairs, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pair = np.cumsum(from_planes(pairs, "<i8"))
            columns = [np.full(len(pair), block), pair, from_planes(docs, "<i8")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "pair", "docs"])


def _told(table: pa.Table) -> pa.Table:
    """One block's pairs with their totals, as sorted arrays."""
    pair, count, best = (table.column(c).to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    return pa.table(
        {
            "block": table.column("block")[:1],
            "count": pa.array([to_planes(count[order])], pa.binary()),
            "best": pa.array([np.packbits(best[order]).tobytes()], pa.binary()),
        }
    )


def _sums(rows: pa.Table, told: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links; a block without links is told nothing."""
    forget()
    row = {c: rows.column(c)[0].as_py() for c in rows.column_names}
    codes, sizes = from_planes(row["codes"], "<u4").astype(np.int64), from_planes(row["sizes"], "<i8")
    link_counts, links = from_planes(row["link_counts"], "<i8"), from_planes(row["links"], "<i8")
    doc = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.zeros((2, len(sizes)), np.int64)
    if told.num_rows:
        pairs = np.cumsum(from_planes(row["pairs"], "<i8"))
        count = from_planes(told.column("count")[0].as_py(), "<i8")
        best = np.unpackbits(np.frombuffer(told.column("best")[0].as_py(), np.uint8), count=len(count)).astype(np.int64)
        at = np.searchsorted(pairs, links)
        for k, values in enumerate((best, count)):
            before = np.concatenate([[0], np.cumsum(values[at])])
            end = np.cumsum(link_counts)
            piece = (before[end] - before[end - link_counts])[codes]
            before = np.concatenate([[0], np.cumsum(piece)])
            end = np.cumsum(sizes)
            sums[k] = before[end] - before[end - sizes]
    per_doc = {c: pa.array(from_planes(row[c], "<i8"), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
    return pa.table(
        {
            "doc_id": pa.array(row["doc_ids"], pa.int64()),
            **per_doc,
            "n_best": pa.array(sums[0], pa.int64()),
            "count_sum": pa.array(sums[1], pa.int64()),
            "groups_sha256": pa.array(row["sha256"], pa.string()),
        }
    )


def documents_aligned(
    docs: DataFrame,
    vocabulary_a: str,
    model_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` the alignment's sums; and the corpus-wide counts: a, b, count, best.

    A is a byte-level file of the tokenizers library over the blank and the text, B a
    sentencepiece model that adds the blank itself; strings of special tokens are plain
    text. A text that is NULL or empty, or whose tokens on either side spell other bytes,
    has no tokens: zeros and an empty groups_sha256. A pair's count is the number of rows
    that hold it linked, so repeated rows count each; it is best where no other B id has a
    higher count with its A id, ties included. Ids may be NULL. An empty table gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    name = f"spokeframe_aligned_{uuid.uuid4().hex}"
    (
        docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
        .mapInArrow(_into_blocks(vocabulary_a, model_b, block_chars), BLOCK)
        .write.bucketBy(shuffle_partitions(spark), "block")
        .option("compression", "none")  # its columns are packed already
        .option("path", new_path(spark, "aligned-blocks"))
        .saveAsTable(name)
    )
    try:
        blocks = spark.table(name)
        pairs = blocks.select("block", "pairs", "pair_docs").mapInArrow(_pairs, COUNTS)
        counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", PAIR_BITS))
        counts = kept(counts, "pair-counts")  # bounded by the two vocabularies
        highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
        totals = counts.join(highest, "a").select("a", "pair", "count", (F.col("count") == F.col("highest")).alias("best"))
        totals = kept(totals, "pair-totals")
        told = pairs.drop("docs").join(totals.drop("a"), "pair").groupBy("block").applyInArrow(_told, "block long, count binary, best binary")
        found = blocks.drop("pair_docs").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_sums, RESULT)
        result = kept(found, "aligned")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    low = F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)
    # A pair that only texts without tokens hold was asked about with no documents.
    return result, totals.where("count > 0").select("a", low.alias("b"), "count", "best")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' byte-level tokens aligned with their sentencepiece tokens."""
    paths = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
    return documents_aligned(read_table(spark, sf_dir, "documents"), *paths)[0]
