"""Language-model scores against a plain version with dictionaries, and edge cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeframe.llm import lm_scoring
from spokeframe.llm.catalog import QUERIES

DOCS = "doc_id long, text string, score double, block string, id string"


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def plain_scores(docs, order=3):
    """The same model, one token at a time."""
    texts = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split() + [b""]) for i, t in docs]
    role = ["out" if crc(i) % 10 == 0 else "held" if crc(i) // 10 % lm_scoring.FOLDS == 0 else "train" for i, _ in texts]

    def counted(roles):
        grams = Counter()
        for (_, words), r in zip(texts, role, strict=True):
            if r in roles:
                seq = [None, *words]
                for n in range(1, order + 1):
                    grams.update(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))
        return grams

    every, less = counted(("train", "held")), counted(("train",))
    words = {g[0]: c for g, c in every.items() if len(g) == 1 and g[0] is not None}
    total, types = sum(words.values()), len(words)
    uniform = 1 / (types + 1)

    def estimates(grams, tokens):
        n = max(1, sum(c for g, c in grams.items() if len(g) == 1 and g[0] is not None))
        seq = [None, *tokens]
        for i in range(1, len(seq)):
            kind, found = 0, [uniform] + [0.0] * order
            found[1] = grams[(seq[i],)] / n
            for k in range(2, order + 1):
                if i >= k - 1 and (seen := grams[tuple(seq[i - k + 1 : i])]):
                    found[k] = grams[tuple(seq[i - k + 1 : i + 1])] / seen
                    kind = (k - 1) * lm_scoring.FREQUENCIES + int(math.log2(seen))
            yield kind, found

    weights = {}

    def weight(kind):
        used = kind // lm_scoring.FREQUENCIES + 2
        return weights.setdefault(kind, [1 / used] * used + [0.0] * (order + 1 - used))

    fold = [x for (_, t), r in zip(texts, role, strict=True) if r == "held" for x in estimates(less, t)]
    before = -math.inf
    for _ in range(lm_scoring.ROUNDS if fold else 0):
        gains, likelihood = {}, 0.0
        for kind, found in fold:
            parts = [w * f for w, f in zip(weight(kind), found, strict=True)]
            likelihood += math.log(sum(parts))
            mine = gains.setdefault(kind, [0.0] * (order + 1))
            for k, p in enumerate(parts):
                mine[k] += p / sum(parts)
        for kind, mine in gains.items():
            mass = [g + lm_scoring.PRIOR if w > 0 else 0 for g, w in zip(mine, weight(kind), strict=True)]
            weights[kind] = [m / sum(mass) for m in mass]
        if likelihood - before <= lm_scoring.ENOUGH * abs(likelihood):
            break
        before = likelihood
    out = []
    for (i, tokens), r in zip(texts, role, strict=True):
        base = sum(math.log10((words.get(t, 0) + 0.1) / (total + 0.1 * (types + 1))) for t in tokens)
        score = sum(math.log10(sum(w * f for w, f in zip(weight(k), found, strict=True))) for k, found in estimates(every, tokens))
        out.append((i, r == "out", len(tokens), sum(t in words for t in tokens), total, base, score))
    return out


def made_up(n=160):
    rng = np.random.default_rng(11)
    vocabulary = ["the", "of", "Été", "a b", "x-1", "THE", "cat", "sat", "on", "mat", " ", "end"]
    docs = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 40), p=rng.dirichlet(np.ones(12))))) for k in range(n)]
    docs += [(None, "the cat"), (None, None), (7, None), (8, ""), (9, "  \n\t "), (10, "the cat sat on the mat"), (10, "the cat sat on the mat")]
    return [*docs, (3, "the\x0bcat\x1fsat\x85on " * 300), (n + 1, "once\ttwice\r\nthrice")]


def assert_same(found, expected):
    def exact(r):
        return (r[0] is not None, r[0] or 0, *r[1:5])

    def order(r):
        return (*exact(r), round(r[5], 6), round(r[6], 6))

    found, expected = sorted(map(tuple, found), key=order), sorted(expected, key=order)
    assert [exact(r) for r in found] == [exact(r) for r in expected]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in expected], rel=1e-12, abs=1e-12)
    assert [r[6] for r in found] == pytest.approx([r[6] for r in expected], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("order", "block", "keys"), [(3, 1000, 50), (4, 150, 20), (1, 64, 10)])
def test_scores_are_those_of_a_plain_version(spark, order, block, keys):
    docs = made_up()
    table = spark.createDataFrame([(i, t, 0.5, "b", "i") for i, t in docs], DOCS).repartition(3)
    found = lm_scoring.scored(table, order=order, block_chars=block, bucket_keys=keys)
    assert_same(found.collect(), plain_scores(docs, order))


def test_without_rows_training_or_a_fold(spark):
    assert lm_scoring.scored(spark.createDataFrame([], DOCS)).count() == 0
    out = next(i for i in range(1000) if crc(i) % 10 == 0)
    train = next(i for i in range(1000) if crc(i) % 10 and crc(i) // 10 % lm_scoring.FOLDS)
    for docs in ([(out, "a b c")], [(train, "a b a b"), (out, "a b z")]):
        found = lm_scoring.scored(spark.createDataFrame([(i, t, 0.5, "b", "i") for i, t in docs], DOCS)).collect()
        assert_same(found, plain_scores(docs))


def test_probabilities_sum_to_one(spark):
    """Of every known word, the end and one unknown word, from texts of one word that are only scored."""
    held = [i for i in range(60000) if crc(i) % 10 == 0]
    docs = [d for d in made_up() if d[0] is None or crc(d[0]) % 10]
    words = sorted({w.decode() for _, t in docs for w in (t or "").encode().lower().split()})
    asked = list(zip(held, ["", "never-seen", *words], strict=False))
    table = spark.createDataFrame([(i, t, 0.5, "b", "i") for i, t in docs + asked], DOCS)
    found = {r.doc_id: r.score for r in lm_scoring.scored(table, order=1).where("held_out").collect()}
    end = found[held[0]]
    assert 10**end + sum(10 ** (found[i] - end) for i, _ in asked[1:]) == pytest.approx(1)


def test_the_query_gives_each_document_once(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op11_lm_scoring"](spark, sf_dir)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert_same(found.collect(), plain_scores(docs))
    better = found.where("held_out").agg(F.sum("score") > F.sum("base_score")).first()[0]
    assert better


def test_what_was_asked_does_not_stay_on_disk(spark, monkeypatch, tmp_path):
    """Questions about words go once answered, and answers are stored once, by block."""
    monkeypatch.setattr(lm_scoring, "new_path", lambda spark, name: str(tmp_path / name))
    docs = [(i, f"w{i % 7} common w{i % 5} common text {i}") for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = lm_scoring.scored(table, block_chars=200, bucket_keys=20)
    assert_same(found.collect(), plain_scores(docs))
    assert not (tmp_path / "lm-answers").exists()
    stored = spark.read.parquet(str(tmp_path / "lm-blocks"))
    assert stored.count() > 1 and stored.where("asks IS NOT NULL").count() == 0


def test_buckets_grow_no_faster_than_the_text(spark, monkeypatch):
    """A power of two of them made each block's questions up to twice as many as the text asks for."""
    seen = []
    blocks = lm_scoring._into_blocks
    monkeypatch.setattr(lm_scoring, "_into_blocks", lambda chars, buckets: seen.append(buckets) or blocks(chars, buckets))
    for copies in (1, 5):
        docs = [(i, "a few words here " * 6) for i in range(20 * copies)]
        lm_scoring.scored(spark.createDataFrame(docs, "doc_id long, text string"), bucket_keys=48).count()
    assert seen[1] <= 5 * seen[0]
