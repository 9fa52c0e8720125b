"""The registered queries with SQL, and the pipeline's stages."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from spokeframe.llm.catalog import ORACLE_SQL, QUERIES
from spokeframe.llm.tables import kept, read_table


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_to_duckdb(spark, sf_dir, name):
    duck = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, sf_dir)
    columns = ", ".join(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(duck.sql(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall())


def test_stages_keep_clean_documents_and_columns(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), "test_stage")
        assert docs.columns == columns, name
        after = docs.count()
        assert 0.5 * before < after <= before
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def sets_of_words(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def brute_no_near_copies(rows, percent=80):
    label, sets = list(range(len(rows))), [sets_of_words(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label = [label[j] if x == label[i] else x for x in label]
    first = {x: min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label)}
    return [r for r, x in zip(rows, label, strict=True) if r[0] == first[x]]


def brute_no_repeated_passages(rows, window=100):
    seen, out = set(), []
    for i, text in rows:
        gone = [False] * len(text)
        for at in range(len(text) - window + 1):
            if text[at : at + window] in seen:
                gone[at : at + window] = [True] * window
            seen.add(text[at : at + window])
        out.append((i, "".join(c for c, g in zip(text, gone, strict=True) if not g)))
    return out


def test_chained_dedup_stages_agree_with_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4000, 200))) for i in range(30)]
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(8)]  # exact copies
    for i in range(8, 16):  # near copies, and copies of those
        words = rows[i][1].split()
        for k in range(3):
            words[20 + 60 * k] = f"x{i}"
            rows.append((200 + 10 * i + k, " ".join(words)))
    for i in range(16, 24):  # passages of an earlier document, long enough or not
        size = 90 if i % 4 == 0 else 180
        words = rows[i][1][:400] + " | " + rows[i - 15][1][300 : 300 + size] + " | " + rows[i][1][400:]
        rows[i] = (i, words)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    smallest: dict = {}
    for i, t in sorted(rows):
        smallest.setdefault(t.lower(), (i, t))
    want = {"exact dedup": sorted(smallest.values())}
    want["near dedup"] = brute_no_near_copies(want["exact dedup"])
    want["suffix-array dedup"] = brute_no_repeated_passages(want["near dedup"])
    chain = [len(rows), *map(len, want.values())]
    assert chain[0] == chain[1] + 8 and chain[1] == chain[2] + 24
    assert want["suffix-array dedup"] != want["near dedup"]
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = kept(stage(spark, docs, ""), "test_chain")
        assert sorted(map(tuple, docs.collect())) == want[name], name
