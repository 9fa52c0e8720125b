"""Whitening against a plain eigendecomposition, and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from spokeframe.llm import whitening
from spokeframe.llm.catalog import QUERIES

ROWS = "vec_id long, embedding array<double>, n string, component string"


def plain(vectors, wanted=4, scale=256):
    """Per row (id, exact deviation, whitened values), the shares explained, and n."""
    rows = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:wanted]
    values, parts = values[order], parts[:, order]
    parts = parts * np.sign(parts[np.abs(parts).argmax(axis=0), np.arange(len(order))])
    trace = float((centred**2).sum() / n)
    found = [
        (i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), (np.array(x) - fit.mean(axis=0)) @ parts / np.sqrt(values))
        for i, x in rows
    ]
    return found, values / trace, n


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "n", "c") for i, v in vectors], ROWS).repartition(3)


def assert_same(found, expected, tolerance=1e-9):
    rows, explained, n = expected
    wanted = len(explained)
    assert len(found) == wanted * len(rows)
    by_row = {}
    for r in found:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        by_row.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened))
    for i, deviation, white in rows:
        for component, value in by_row[i, deviation]:
            assert value == pytest.approx(white[component - 1], abs=tolerance)


def test_whitening_is_the_eigendecomposition(spark):
    rng = np.random.default_rng(12)
    vectors = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((300, 9)) @ np.diag(1.5 ** np.arange(9)) @ rng.standard_normal((9, 9)))]
    vectors += [(7, vectors[3][1]), (None, vectors[4][1]), (900, None), (901, [float("nan")] * 9), (902, [None] * 9)]
    vectors += [(903, [float("inf")] + [0.0] * 8)] + [(k, vectors[0][1]) for k in range(1000, 1200)]
    assert_same(whitening.whitened(table(spark, vectors)).collect(), plain(vectors))


def test_equal_eigenvalues_are_all_found(spark):
    corners = [[s * 2.0 if a == d else 0.0 for a in range(6)] for d in range(6) for s in (1, -1)]
    found = whitening.whitened(table(spark, list(enumerate(corners)))).collect()
    assert len(found) == 4 * 12
    assert {round(r.explained, 12) for r in found} == {round(1 / 6, 12)}
    white = {(r.vec_id, r.component): r.whitened for r in found}
    matrix = np.array([[white[i, c] for c in (1, 2, 3, 4)] for i in range(12)])
    assert np.allclose(matrix.T @ matrix / 12, np.eye(4), atol=1e-12)


def test_fewer_components_than_asked_for(spark):
    line = [(k, [k / 256, 2 * k / 256, 0.0, 0.0, 0.0]) for k in range(20)]
    found = whitening.whitened(table(spark, line)).collect()
    assert {r.component for r in found} == {1} and len(found) == 20
    assert all(r.explained == pytest.approx(1) for r in found)
    for vectors in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, None)]):
        assert whitening.whitened(table(spark, vectors)).count() == 0


def test_lengths_are_whitened_apart_and_large_numbers_are_exact_or_an_error(spark):
    rng = np.random.default_rng(3)
    short = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((30, 2)))]
    long = [(100 + k, v.tolist()) for k, v in enumerate(rng.standard_normal((40, 5)) * [1, 2, 4, 8, 16])]
    found = whitening.whitened(table(spark, short + long)).collect()
    assert_same([r for r in found if r.vec_id < 100], plain(short))
    assert_same([r for r in found if r.vec_id >= 100], plain(long))
    far = [(1, [3.0e5, 0.0]), (2, [-3.0e5, 1.0]), (3, [7.0, 5.0])]
    assert_same(whitening.whitened(table(spark, far)).collect(), plain(far))
    for entry in (1e17, 1e8):  # an entry, and a deviation, that need more than 64 bits
        with pytest.raises(Exception, match="64 bits|too large|Error converting|int"):
            whitening.whitened(table(spark, [(1, [entry, 0.0]), (2, [-entry, 1.0]), (3, [0.0, 5.0])])).collect()


def test_the_query(spark, sf_dir):
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = QUERIES["op12_whitening"](spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert_same(found.collect(), plain(vectors), tolerance=1e-8)
