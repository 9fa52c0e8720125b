"""Toxicity by a counterfactual-regularised linear classifier.

A document's score is the sum of its distinct words' weights; a word's weight is that
of the word itself and of its beginnings, hashed to buckets. Fitting minimises the
logistic loss with a sparse penalty, plus a penalty on how much the score of a labelled
sentence changes when its identity terms are swapped for others of their group, so that
naming a group is not what makes a text toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import stratified
from .tables import column, fold, free_name, read_table
from .workers import forget

PER_CLASS = 2000  #: labelled documents of each class that the model is fitted on, about
BUCKETS = 1 << 20
SPARSE = 6e-3  #: weight of the sum of absolute weights when features are chosen
SPARSE_AGAIN = 1e-5  #: ... and when the chosen ones are fitted again
FAIR = 1.0  #: weight of the squared score change under swaps
STEPS, STEPS_AGAIN = 100, 600
FLOOR = 0.01  #: added to a feature's mean square before its root scales it down
REMEMBERED = 100_000  #: words whose weight a worker remembers
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

#: Identity terms by group; a term is swapped for the next of its group. Fixed values.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)


def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, str]:
    return {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def buckets_of(word: str) -> list[int]:
    """The word and, if longer, its first four and five letters."""
    names = [word + "$"] + [word[:n] for n in (4, 5) if len(word) >= n]
    return [zlib.crc32(name.encode()) % BUCKETS for name in names]


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the buckets that matter, and the intercept."""

    weights: dict[int, float]
    intercept: float

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(b, 0.0) for b in buckets_of(word))


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.memo = model, {}

    def score(self, text: str) -> float:
        """Probability of the toxic label."""
        words = words_of(text)
        memo = self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
        for word in words:
            if word not in memo:
                memo[word] = self.model.word_weight(word)
        # Sorted, so that the sum does not depend on the order of a set.
        total = self.model.intercept + float(sum(sorted(w for w in map(memo.__getitem__, words) if w)))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


class _Sparse:
    """Rows of bucket counts, for products with weights and the transpose."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], columns: np.ndarray):
        """Rows are (buckets, values); buckets that are not in the sorted ``columns`` are left out."""
        none = np.zeros(0, np.int32)
        bucket = np.concatenate([none, *[b for b, _ in rows]])
        col = np.searchsorted(columns, bucket).astype(np.int32)
        stay = columns[np.minimum(col, len(columns) - 1)] == bucket if len(columns) else np.zeros(len(bucket), bool)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(b) for b, _ in rows])[stay]
        self.col = col[stay]
        self.value = np.concatenate([np.zeros(0), *[v for _, v in rows]])[stay]
        self.shape = (len(rows), len(columns))

    def only(self, columns: np.ndarray) -> _Sparse:
        """These columns alone."""
        place = np.full(self.shape[1], -1)
        place[columns] = np.arange(len(columns))
        stay = place[self.col] >= 0
        part = _Sparse.__new__(_Sparse)
        part.row, part.col, part.value = self.row[stay], place[self.col[stay]], self.value[stay]
        part.shape = (self.shape[0], len(columns))
        return part

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.col], minlength=self.shape[0])

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * errors[self.row], minlength=self.shape[1])


def _counts(words: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and how many words each is of."""
    buckets, counts = np.unique(np.array([b for w in words for b in buckets_of(w)], np.int32), return_counts=True)
    return buckets, counts.astype(float)


def _difference(sentence: set[str], swapped: set[str]) -> tuple[np.ndarray, np.ndarray]:
    (a, x), (b, y) = _counts(sentence), _counts(swapped)
    buckets, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    change = np.bincount(where, np.concatenate([x, -y]), minlength=len(buckets))
    return buckets[change != 0], change[change != 0]


def fit(
    texts: list[str],
    toxic: list[int],
    share: float,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    fair: float = FAIR,
) -> ToxicityModel:
    """A model from labelled texts; ``share`` is the toxic share at large, for the intercept.

    With one class only, or none, every text gets that class's share.
    """
    label = np.array(toxic, float)
    share = min(max(share, 1e-6), 1 - 1e-6)
    if not len(label) or label.min() == label.max():
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    rows = [_counts(words_of(t)) for t in texts]
    swap = swaps(groups)
    pairs = []
    for text in texts:
        low = text.lower()
        if not swap.keys().isdisjoint(WORD.findall(low)):
            for sentence in SENTENCE.split(low):
                words = words_of(sentence)
                if not swap.keys().isdisjoint(words):
                    pairs.append(_difference(words, {swap.get(w, w) for w in words}))
    seen, texts_with = np.unique(np.concatenate([b for b, _ in rows]), return_counts=True)
    in_pairs = [b for b, _ in pairs] or [np.zeros(0, np.int32)]
    columns = np.union1d(seen[texts_with >= 3], np.concatenate(in_pairs)).astype(np.int32)
    x, d = _Sparse(rows, columns), _Sparse(pairs, columns)
    # Rare features get longer steps and cost less: common words would rule both otherwise.
    square = np.bincount(x.col, x.value**2, minlength=len(columns)) / len(rows)
    scale = 1 / np.sqrt(square + FLOOR)
    x.value, d.value = x.value * scale[x.col], d.value * scale[d.col]
    # Both classes weigh the same; the intercept is set to the share at large below.
    weight = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    # The penalty chooses features and shrinks their weights; the second fit has only the chosen ones.
    w, _ = _descend(x, d, label, weight, SPARSE, fair, STEPS)
    chosen = np.flatnonzero(np.abs(w) > 1e-9)
    columns, scale = columns[chosen], scale[chosen]
    x, d = x.only(chosen), d.only(chosen)
    w, b = _descend(x, d, label, weight, SPARSE_AGAIN, fair, STEPS_AGAIN)
    w = w * scale
    prior = float(np.log(share / (1 - share)))
    return ToxicityModel(dict(zip(columns.tolist(), w.tolist(), strict=True)), b + prior)


def _descend(
    x: _Sparse, d: _Sparse, label: np.ndarray, weight: np.ndarray, sparse: float, fair: float, steps: int
) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps."""
    pairs = max(1, d.shape[0])
    w, momentum, b, momentum_b = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    step_size, t = 4.0, 1.0

    def loss(v: np.ndarray, c: float) -> tuple[float, np.ndarray]:
        z = x.times(v) + c
        value = float((weight * (np.logaddexp(0, z) - label * z)).sum())
        return value + fair * float((d.times(v) ** 2).sum()) / pairs, z

    for _ in range(steps):
        value, z = loss(momentum, momentum_b)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label)
        gradient = x.back(error) + 2 * fair * d.back(d.times(momentum)) / pairs
        slope = float(error.sum())
        while True:  # a step that the quadratic bound allows
            moved = momentum - step_size * gradient
            new = np.sign(moved) * np.maximum(np.abs(moved) - step_size * sparse, 0)
            new_b = momentum_b - step_size * slope
            away, away_b = new - momentum, new_b - momentum_b
            allowed = value + gradient @ away + slope * away_b + (away @ away + away_b**2) / (2 * step_size)
            if loss(new, new_b)[0] <= allowed + 1e-12 or step_size < 1e-9:
                break
            step_size /= 2
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum, momentum_b = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return w, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    toxic_col: str = "toxic",
    per_class: int = PER_CLASS,
) -> ToxicityModel:
    """Fit on about ``per_class`` labelled whole texts of each class.

    A document with several labels is toxic if one says so. Labels without id or value,
    and labels of documents that are not there, teach nothing; a NULL text is empty.
    """
    marked = (
        labels.where(column(id_col).isNotNull() & column(toxic_col).isNotNull())
        .groupBy(column(id_col).alias("id"))
        .agg((F.max(column(toxic_col)) > 0).cast("int").alias("toxic"))
    )
    sample, counts = stratified(marked, "toxic", "id", per_class)
    # At most four times per_class ids: small at any size of the input.
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(sample), "id").select("toxic", "text").limit(8 * per_class).collect()
    found = sorted((r.toxic, r.text) for r in found)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([t for _, t in found], [y for y, _ in found], share)


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on), from every whole text.

    NULL counts as empty; an empty text gets the score of no words. New columns are
    lengthened where the table has such names. Rows stay, repeated ones too.
    """
    score, predicted = (free_name(docs, n) for n in ("score", "predicted"))

    # Only scores come back from Python; the rows wait in the JVM meanwhile.
    @F.arrow_udf("double")
    def score_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        scorer = Scorer(model)
        for part in parts:
            yield pa.array([scorer.score(t.as_py() or "") for t in part], pa.float64())

    # Called nondeterministic so that a filter on the verdict does not score again.
    found = docs.select("*", score_of.asNondeterministic()(column(text_col)).alias(score))
    return found.select("*", (F.col(score) >= 0.5).cast("int").alias(predicted))


def learned(spark: SparkSession, sf_dir: str, docs: DataFrame) -> ToxicityModel:
    """Fitted on the labels of four in five documents."""
    labels = read_table(spark, sf_dir, "labels")
    return train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels of one in five are never learned from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, learned(spark, sf_dir, docs)).drop("text")
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
