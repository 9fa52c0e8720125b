"""Alignment of two tokenizers against a plain version, and edge cases."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from spokeframe.llm import alignment
from spokeframe.llm.catalog import QUERIES
from spokeframe.llm.vocabulary import BYTE_LETTERS, public_path

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, block string, n_a int, count string"
RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    (1, "Hello World, hello world"),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "a  b\n\n c \n  d   \n"),
    (6, "ÄÖÜ straße été naïve ½ ² ﬁ ① é क़ 🙂🙂 日本語 テキスト"),
    (7, "x▁y ▁ z"),
    (8, "tab\there\x0b and\x0c \r\n there  nbsp　wide ​ zero\x85"),
    (9, "x <|endoftext|> y <s> </s> <unk> <0x41>"),
    (10, "the quick brown fox jumps over a lazy dog " * 300),
    (11, "Hello World, hello world"),
    (11, "Hello World, hello world"),
    (None, "don't we'll 123,456.78!? --- ###"),
    (13, "\n leading and trailing \n"),
    (14, "\x00 nul \x01﻿ ퟿"),
    (15, "a" * 5000),
    (16, "supercalifragilisticexpialidocious " + "wörter" * 20),
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain_tokens(libraries, text):
    """(ids, bytes) of both sides of a whole text; None where it has no tokens."""
    if not text:
        return None
    letters = {v: k for k, v in BYTE_LETTERS.items()}
    a, b = libraries
    left = a.encode(f" {text}", add_special_tokens=False)
    a_bytes = [bytes([letters.get(c, ord(c) % 256) for c in t]) for t in (a.id_to_token(i) for i in left.ids)]
    right = b.encode(text)
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in right)]
    if b"".join(a_bytes) != f" {text}".encode() or b"".join(b_bytes) != f" {text}".encode():
        return None
    return list(zip(left.ids, a_bytes, strict=True)), list(zip(right, b_bytes, strict=True))


def plain_groups(tokens):
    """Groups of (A ids, B ids): cut where both sides end."""
    if tokens is None:
        return []
    cuts, at = [set(), set()], [0, 0]
    for k in (0, 1):
        for _, raw in tokens[k]:
            at[k] += len(raw)
            cuts[k].add(at[k])
    groups, both = [], sorted(cuts[0] & cuts[1])
    for k in (0, 1):
        place = n = 0
        for i, raw in tokens[k]:
            if n == len(groups):
                groups.append(([], []))
            groups[n][k].append(i)
            place += len(raw)
            n += place == both[n]
    return groups


def plain(libraries, docs):
    grouped = [(i, t, plain_groups(plain_tokens(libraries, t))) for i, t in docs]
    links = [[(a, b) for x, y in groups for a in x for b in y] for _, _, groups in grouped]
    count = Counter(p for found in links for p in set(found))
    highest = Counter()
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for (i, _, groups), found in zip(grouped, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best, total = sum(count[p] == highest[p[0]] for p in found), sum(count[p] for p in found)
        sizes = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(found)
        out.append((i, *sizes, best, total, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, {(a, b): (n, n == highest[a]) for (a, b), n in count.items()}


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("chars", [60, 4 << 20])
def test_alignment_is_that_of_a_plain_version(spark, libraries, chars):
    docs = spark.createDataFrame([(i, t, "b", 1, "c") for i, t in TEXTS], DOCS).repartition(3)
    found, counts = alignment.documents_aligned(docs, A, B, block_chars=chars)
    expected, pairs = plain(libraries, TEXTS)
    assert found.columns == RESULT
    assert by_id(found.collect()) == by_id(expected)
    assert {(r.a, r.b): (r["count"], r.best) for r in counts.collect()} == pairs


def test_without_rows_or_tokens(spark):
    found, counts = alignment.documents_aligned(spark.createDataFrame([], DOCS), A, B)
    assert found.count() == 0 and counts.count() == 0
    docs = spark.createDataFrame([(1, None, "b", 1, "c"), (2, "", "b", 1, "c"), (3, "▁", "b", 1, "c")], DOCS)
    found, counts = alignment.documents_aligned(docs, A, B)
    assert by_id(found.collect()) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)] and counts.count() == 0


def test_intervals_coalesce_as_cuts_do():
    rng = np.random.default_rng(13)
    for _ in range(50):
        size = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, size + 1)), size)) for _ in range(2)]
        a, b, groups = alignment.coalesced(*ends)
        both = np.intersect1d(*ends)
        assert groups == len(both)
        assert (a == np.searchsorted(both, ends[0])).all() and (b == np.searchsorted(both, ends[1])).all()
        pairs = list(zip(*(x.tolist() for x in alignment.expanded(a, b, groups)), strict=True))
        assert pairs == [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]


def test_pieces_have_the_ids_of_whole_texts(libraries):
    """All characters of some ranges, at the places where a cut could matter."""
    a, b = alignment.sides(A, B)
    marks = [chr(c) for r in ((32, 0x2000), (0x2000, 0x3400), (0xF900, 0xFB50), (0x1D100, 0x1D1FF)) for c in range(*r)]
    for begin in range(0, len(marks), 97):
        text = "".join(f" {c} x{c} {c}y\n{c}!  {c}, a{c}#\n" for c in marks[begin : begin + 97])
        if a.is_whole(f" {text}") or b.is_whole(f" {text}"):
            continue
        pieces, sizes = alignment._cut([f" {text}"], [False])
        in_order = [pieces.dictionary[i].as_py() for i in pieces.indices.to_pylist()]
        assert "".join(in_order) == f" {text}" and sizes.tolist() == [len(in_order)]
        assert np.frombuffer(b"".join(a.ids(in_order)), "<u4").tolist() == libraries[0].encode(f" {text}", add_special_tokens=False).ids
        assert np.frombuffer(b"".join(b.ids(in_order)), "<u4").tolist() == libraries[1].encode(text)


def test_the_query(spark, sf_dir, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op13_alignment"](spark, sf_dir)
    assert found.columns == RESULT
    assert by_id(found.collect()) == by_id(plain(libraries, docs)[0])
