"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows of the distinct vectors, the method builds orthonormal u's (one
number a row) and v's (one a dimension) so that X v_j = beta_(j-1) u_(j-1) + alpha_j u_j
and X' u_j = alpha_j v_j + beta_j v_(j+1). The singular values of the small bidiagonal
matrix of alphas and betas tend to those of X, the largest first, and the covariance's
eigenvectors come from its right singular vectors.

Every u is X times a known vector of one number a dimension, so the driver keeps that
vector and a pass makes the u's anew block by block; nothing as long as the table is ever
kept, moved or collected. A pass takes p = X z for a vector z and returns p'p and X'p,
sums of a number a dimension. From X'p come the products of p with all earlier u's, so
that each u is orthogonalised against all of them, with a second pass where rounding asks
for it; each v is orthogonalised on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import column, kept, read_table
from .workers import forget

COMPONENTS = 4
SCALE = 256
BLOCK_NUMBERS = 1 << 19  #: entries of a block of vectors, about
CONVERGED = 1e-14  #: a singular triplet's residual against the largest singular value
NOTHING = 1e-13  #: below this share of the largest, a singular value or a step counts as 0
WHOLE = float(1 << 62)  #: integers from here on would not fit 64 bits with room for a sign


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each entry; NULL for a vector that takes no part; an error beyond 64 bits."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(_fits(F.lit(float(scale)) * x.cast("double"))).cast("long"))
    return F.when(vector.isNotNull() & ~bad, scaled)


def _fits(x: Column) -> Column:
    return F.when(F.abs(x) < WHOLE, x).otherwise(F.raise_error(F.lit("an entry is too large for 64 bits")).cast("double"))


@dataclass(frozen=True)
class Whitening:
    """What is learned from the distinct vectors of one length."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  #: a column per component
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one length as blocks of 64-bit integers."""
    forget()
    for batch in batches:
        vectors = batch.column(0)
        wide = len(vectors[0]) if len(vectors) else 0
        step = max(1, BLOCK_NUMBERS // max(1, wide))
        for at in range(0, len(vectors), step):
            part = vectors.slice(at, step)
            numbers = part.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(part)], pa.int64()), pa.array([numbers.tobytes()], pa.binary())], names=["rows", "numbers"]
            )


def _summed(blocks: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of an array of a fixed, small size that ``work`` makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = None
        for batch in batches:
            for rows, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = work(np.frombuffer(raw.as_buffer(), "<i8").reshape(rows, -1))
                total = part if total is None else total + part
        if total is not None:
            places = pa.array(np.arange(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array(total, pa.float64())], names=["place", "part"])

    sums = blocks.mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("total"))
    return np.array([r.total for r in sorted(sums.collect())])


class _Rows:
    """The centred rows, seen through their products."""

    def __init__(self, blocks: DataFrame, n: int, sums: tuple[int, ...]):
        self.blocks, self.n, self.dim = blocks, n, len(sums)
        self.sums = np.array(sums, object)
        self.mean = np.array([s / n for s in sums])  # division of integers is rounded once
        self.most = max(1, max(abs(s) for s in sums))

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n; as (n x - S) / n, rounded once, where 64 bits hold it."""
        n, mean, most = self.n, self.mean, self.most
        small = np.array(self.sums, np.int64) if most < 1 << 62 else None

        def centred(x: np.ndarray) -> np.ndarray:
            if small is not None and int(np.abs(x).max(initial=0)) * n + most < 1 << 62:
                return (x * n - small) / n
            return x - mean

        return centred

    def products(self, direction: np.ndarray) -> tuple[float, np.ndarray]:
        """For p = X direction: p'p and X'p."""
        centred = self.centre()

        def work(x: np.ndarray) -> np.ndarray:
            rows = centred(x)
            p = rows @ direction
            return np.concatenate([[p @ p], p @ rows])

        found = _summed(self.blocks, work)
        return float(found[0]), found[1:]


def bidiagonalised(rows: _Rows, wanted: int, trace: float, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values of the rows, with their right singular vectors as columns.

    ``trace`` is the sum of all squared singular values. The steps end where the wanted
    triplets have converged and what the found ones leave of the trace has no room for
    another as large, or where all dimensions are used up. A step that comes out as nothing
    (an invariant subspace, as with equal singular values) goes on with a new direction.
    """
    dim, rng = rows.dim, np.random.default_rng(seed)

    def fresh(basis: np.ndarray) -> np.ndarray:
        v = rng.standard_normal(dim)
        for _ in range(2):
            v -= basis @ (basis.T @ v)
        return v / np.linalg.norm(v)

    right = np.zeros((dim, 0))  # the v's
    left = np.zeros((dim, 0))  # each u is X times its column
    across = np.zeros((dim, 0))  # X'u of each
    bidiagonal = np.zeros((0, 0))
    size = np.sqrt(trace)
    v, beta = fresh(right), 0.0
    while True:
        j = right.shape[1]
        right = np.column_stack([right, v])
        direction = v - beta * left[:, -1] if j else v
        for _ in range(2):  # against all earlier u's; again if so much went that rounding counts in what is left
            before, back = rows.products(direction)
            inner = left.T @ back  # U'p, as each u is X times its column
            direction, square, back = direction - left @ inner, before - float(inner @ inner), back - across @ inner
            if square > before / 2:
                break
        alpha = np.sqrt(max(0.0, square))
        grown = np.zeros((j + 1, j + 1))
        grown[:j, :j] = bidiagonal
        if j:
            grown[j - 1, j] = beta
        if alpha <= NOTHING * size:  # X v lies in the span of the u's: a zero singular value
            alpha = 0.0
            left, across = np.column_stack([left, np.zeros(dim)]), np.column_stack([across, np.zeros(dim)])
            rest = np.zeros(dim)
        else:
            left, across = np.column_stack([left, direction / alpha]), np.column_stack([across, back / alpha])
            rest = across[:, -1] - alpha * v
        grown[j, j] = alpha
        bidiagonal = grown
        for _ in range(2):
            rest = rest - right @ (right.T @ rest)
        beta = float(np.linalg.norm(rest))
        lost = beta <= NOTHING * size
        beta = 0.0 if lost else beta
        turn, values, across_t = np.linalg.svd(bidiagonal)
        if j + 1 == dim:
            break
        # The residual of a triplet is beta times the last entry of its left vector.
        settled = j + 1 >= wanted and np.all(beta * np.abs(turn[-1, :wanted]) <= CONVERGED * values[0])
        if settled and trace - float((values**2).sum()) < values[wanted - 1] ** 2 * (1 - 1e-6):
            break
        v = fresh(right) if lost else rest / beta
    found = min(wanted, len(values))
    return values[:found], right @ across_t[:found].T


def learned(vectors: DataFrame, dim: int, wanted: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct rows of ``vectors`` (one column x of ``dim`` integers).

    Components with no variance (constant dimensions, fewer vectors than components) are
    left out; None if there is none.
    """
    blocks = kept(vectors.distinct().mapInArrow(_packed, "rows long, numbers binary"), "distinct-vectors")
    n, *sums = _exact_sums(blocks, dim)
    rows = _Rows(blocks, n, tuple(sums))
    centred = rows.centre()
    trace = float(_summed(blocks, lambda x: np.array([(centred(x) ** 2).sum()]))[0])
    if not trace > 0:
        return None
    values, components = bidiagonalised(rows, min(wanted, dim), trace)
    real = values > NOTHING * np.sqrt(trace)
    values, components = values[real], components[:, real]
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(values))])
    eigenvalues = values**2 / n
    projection = components / np.sqrt(eigenvalues)
    k = len(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        y = centred(x) @ projection
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    found = _summed(blocks, whitened)
    mean = found[:k] / n
    covariance = found[k:].reshape(k, k) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(k)).max())
    return Whitening(n, tuple(sums), components, eigenvalues, eigenvalues * n / trace, error)


def _exact_sums(blocks: DataFrame, dim: int) -> list[int]:
    """Number of vectors and the sum of each dimension, as integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dim + 1)
        for batch in batches:
            for rows, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), "<i8").reshape(rows, -1)
                if rows * int(np.abs(x).max(initial=0)) >= 1 << 62:
                    x = x.astype(object)
                total = [a + int(b) for a, b in zip(total, [rows, *x.sum(axis=0)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([str(t) for t in total])], names=["place", "part"])

    found = blocks.mapInArrow(run, "place int, part string").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    return [int(r.total) for r in sorted(found.collect())]


def _apply(model: Whitening):
    """A row per vector and component."""
    n, sums = model.n, model.sums
    projection = model.components / np.sqrt(model.eigenvalues)
    centred = _Rows(None, n, sums).centre()
    k = len(model.eigenvalues)
    most = max(1, max(abs(s) for s in sums))

    def deviations(x: np.ndarray) -> list[int]:
        far = int(np.abs(x).max(initial=0)) * n + most
        if far * far * len(sums) < 1 << 63:
            return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(count, -1)
            columns = {
                "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(count), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()),
                "n": pa.array(np.full(count * k, n), pa.int64()),
                # an integer beyond 64 bits is an error here, never another number
                "deviation": pa.array([d for d in deviations(x) for _ in range(k)], pa.int64()),
                "whitened": pa.array((centred(x) @ projection).ravel(), pa.float64()),
                "explained": pa.array(np.tile(model.explained, count), pa.float64()),
                "identity_error": pa.array(np.full(count * k, model.identity_error), pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(
    vectors: DataFrame,
    wanted: int = COMPONENTS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """A row per vector and component, up to ``wanted`` of them: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries count as floor(scale * x). Vectors that are NULL or hold NULL or a non-finite
    number are left out; ids may be NULL or repeated. The components are learned from each
    distinct vector once, numbered by falling eigenvalue, and have either sign, the same for
    all rows (the entry largest in size is positive). Vectors of another length are whitened
    by themselves. Components without variance are left out, so equal vectors, a single one,
    empty ones and an empty table give no rows. A number that 64 bits can't hold is an error.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        column(id_col).cast("long").alias("vec_id"), whole_numbers(column(vector_col), scale).alias("x")
    ).where("x IS NOT NULL AND size(x) > 0")
    rows = kept(rows, "whole-vectors")
    out = None
    for length in rows.select(F.size("x").alias("dim")).distinct().orderBy("dim").collect():  # one row per length
        own = rows.where(F.size("x") == length.dim)
        model = learned(own.select("x"), length.dim, wanted)
        if model is not None:
            found = own.mapInArrow(_apply(model), SCHEMA)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of all embeddings."""
    return whitened(read_table(spark, sf_dir, "embeddings"))
