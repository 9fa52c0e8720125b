"""Byte-level BPE by ranks: encoding in linear time by backtracking, and decoding.

A sequence of tokens is what the merges would give exactly if every two neighbours
are, that is if the merges turn the bytes of the two into the same two tokens. So an
encoder may take the longest token at each place, go to the next shorter one where the
pair does not hold, and step back where none is left, never entering a place twice.
Longest tokens come from one Aho-Corasick pass over the bytes (as Latin-1 characters);
whether a pair holds is found once with the merges themselves and remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import column, free_name, read_table
from .vocabulary import LONGEST, PIECE, UNCLEAR_SPACE, public_path
from .workers import remembered

#: Entries a worker remembers of each kind (pieces of text, pairs of tokens).
REMEMBERED_PIECES = 500_000
REMEMBERED_PAIRS = 500_000


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks = ranks
        self.words = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: bytes) -> list[int]:
        """Tokens by the merges one at a time, lowest rank first, leftmost of equals; for short texts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min(
                ((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            )
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def holds(self, left: int, right: int) -> bool:
        """Whether the merges leave these two neighbours as they are."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of this one; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            text = self.bytes_of[token]
            found = next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), -1)
            self.shorter[token] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        size = len(word)
        longest, reach = [-1] * size, [0] * size
        for end, (length, rank) in self.automaton.iter(word.decode("latin-1")):
            begin = end - length + 1
            if length > reach[begin]:
                longest[begin], reach[begin] = rank, length
        bytes_of, tokens, at, closed = self.bytes_of, [], 0, set()
        token = longest[0]
        while at < size:
            while token != -1:
                end = at + len(bytes_of[token])
                if end not in closed and (not tokens or self.holds(tokens[-1], token)):
                    break
                token = self.next_shorter(token)
            if token != -1:
                tokens.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:  # nothing fits here after the last token: never come back to this place
                closed.add(at)
                token = tokens.pop()
                at -= len(bytes_of[token])
        return tokens

    def _piece(self, piece: str) -> bytes:
        """Ids of each match of the pattern; a match that was met before as a piece is known."""
        out = []
        for word in self.words.findall(piece):
            ids = self.memo.get(word) or self.older.get(word)
            if ids is None:
                ids = np.array(self.encode_word(word.encode()), "<u4").tobytes()
                if len(word) <= LONGEST:
                    self.memo[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > REMEMBERED_PIECES // 2:
            self.older, self.memo = self.memo, {}
        if UNCLEAR_SPACE.search(text):
            return self._piece(text)
        memo, older, out = self.memo, self.older, []
        for piece in PIECE.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = older.get(piece)
                if ids is None:
                    ids = self._piece(piece)
                if len(piece) <= LONGEST:
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()])


@remembered(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    """One per worker process and rank file."""
    return Bpe(path, pattern)


def _added(table: DataFrame, read: str, name: str, work) -> DataFrame:
    """``table`` and a binary column ``name`` made batch by batch from column ``read``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            values = pa.array([function(x.as_py()) for x in batch.column(batch.schema.get_field_index(read))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    schema = table.select("*", F.lit(b"").alias(name)).schema
    return table.mapInArrow(run, schema)


def encoded(table: DataFrame, ranks: str, pattern: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``table`` with the packed ids (little-endian uint32) of every whole text.

    Each match of ``pattern`` is encoded separately, without special tokens. NULL counts
    as empty, an empty text has no ids, repeated rows are encoded each. ``name`` is
    lengthened if the table has such a column already. An empty table stays empty.
    """
    name = free_name(table, name)

    def work():
        tokens = bpe(ranks, pattern)
        return lambda text: tokens.encode(text or "")

    return _added(table, text_col, name, work)


def decoded(table: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``table`` with the bytes that packed ids stand for; NULL ids give no bytes."""
    name = free_name(table, name)

    def work():
        tokens = bpe(ranks, pattern)
        return lambda ids: tokens.decode(ids or b"")

    return _added(table, ids_col, name, work)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    import public_tokenizers

    ranks, pattern = public_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select(column("doc_id"), column("text"))
    ids = encoded(docs, ranks, pattern).drop("text")
    return decoded(ids, ranks, pattern).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
