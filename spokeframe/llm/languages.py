"""Language identification: averaged subword embeddings and a linear softmax.

Byte n-grams inside words are hashed to buckets; a text is the mean of its buckets'
embeddings, a linear layer gives a score per language, and both are learned by
stochastic gradient descent in numpy on the driver, from a bounded sample. For
prediction the two are one table of scores per bucket. A temperature fitted on
documents kept out of the training makes the probability honest, and a threshold
found there tells which predictions to reject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import stratified
from .tables import column, fold, free_name, read_table

PER_LANGUAGE = 600  #: documents of each language that the model is fitted on, about
BUCKETS = 1 << 16
DIMENSIONS = 16
EPOCHS = 4
WANTED_PRECISION = 0.99  #: of the predictions that are not rejected, on the documents kept out
SIZES = (2, 3, 4)
BLOCK = 1 << 20  #: bytes scored at once
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"

_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLDED[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLDED[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, starts: int, size: int) -> np.ndarray:
    """Bucket of the n-gram at each of the first ``starts`` places; BUCKETS where it is none.

    Bytes other than letters count as blanks; an n-gram may begin or end with one.
    """
    parts = [data[k : k + starts] for k in range(size)]
    value = np.full(starts, size, np.uint64)
    for part in parts:
        value = (value << np.uint64(8)) | part
    bucket = ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BUCKETS
    inner = parts[1:-1] if size > 2 else []
    none = (parts[0] == 32) & (parts[-1] == 32) if size == 2 else np.zeros(starts, bool)
    for part in inner:
        none |= part == 32
    bucket[none] = BUCKETS
    return bucket


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    data = _FOLDED[np.frombuffer(text.encode(), np.uint8)]
    found = [_grams(data, len(data) - n + 1, n) for n in SIZES if len(data) >= n]
    buckets, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    real = buckets < BUCKETS
    return buckets[real], counts[real]


@dataclass(frozen=True)
class LanguageModel:
    """Scores per bucket and language; temperature and threshold from documents kept out."""

    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS + 1 rows, the last of zeros
    temperature: float
    threshold: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean score per text and language; ``offsets`` has each text's place in ``data``."""
        rows = len(offsets) - 1
        total, count = np.zeros((rows, len(self.languages))), np.zeros(rows)
        begin, stop = int(offsets[0]), int(offsets[-1])
        for at in range(begin, stop, BLOCK):
            end = min(at + BLOCK, stop)
            part = _FOLDED[data[at : min(end + SIZES[-1] - 1, stop)]]
            first = int(np.searchsorted(offsets, at, side="right")) - 1
            last = int(np.searchsorted(offsets, end, side="left"))
            edges = offsets[first : last + 1]
            places = np.maximum(edges[:-1], at) - at  # where each text begins here
            full = np.diff(np.append(places, end - at)) > 0
            for n in SIZES:
                starts = min(end - at, len(part) - n + 1)
                if starts <= 0:
                    continue
                bucket = np.full(end - at, BUCKETS)
                bucket[:starts] = _grams(part, starts, n)
                for k in range(1, n):  # n-grams that would reach into the next text
                    over = edges[1:] - k - at
                    bucket[over[(over >= 0) & (over < end - at)]] = BUCKETS
                where = places[full]
                rows_here = first + np.flatnonzero(full)
                total[rows_here] += np.add.reduceat(self.table[bucket], where, axis=0)
                count[rows_here] += np.add.reduceat(bucket < BUCKETS, where)
        return total / np.maximum(count, 1)[:, None]

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        scaled = scores / self.temperature
        e = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _descend(
    samples: list[tuple[np.ndarray, np.ndarray, int]], languages: int, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    embeddings = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights = np.zeros((DIMENSIONS, languages), np.float32)
    steps, step = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            buckets, counts, label = samples[i]
            rate = 0.5 * (1 - step / steps)
            step += 1
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ embeddings[buckets]
            score = hidden @ weights
            wrong = np.exp(score - score.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = weights @ wrong
            weights -= rate * np.outer(hidden, wrong)
            embeddings[buckets] -= rate * np.outer(share * len(buckets) ** 0.5, back)
    return embeddings, weights


def fit(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel | None:
    """A model from labelled texts; None if no text has a letter.

    Each text also teaches by a short stretch of it, so that short texts are not strange.
    One in five texts is kept out to fit the temperature and the threshold.
    """
    rng = np.random.default_rng(seed)
    known = [(t, y) for t, y in zip(texts, labels, strict=True) if t and LETTER.search(t)]
    languages = tuple(sorted({y for _, y in known}))
    train, held = [], []
    for text, label in known:
        words = text.split()
        at = int(rng.integers(0, max(1, len(words) - 8)))
        short = " ".join(words[at : at + int(rng.integers(2, 9))])
        target = held if rng.random() < 0.2 else train
        for part in (text, short):
            buckets, counts = features(part)
            if len(buckets):
                target.append((buckets, counts, languages.index(label)))
    if not languages:
        return None
    embeddings, weights = _descend(train, len(languages), rng)
    table = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    table[:-1] = embeddings @ weights
    if not held:
        return LanguageModel(languages, table, 1.0, 0.0)
    scores = np.array([(c / c.sum()) @ table[b] for b, c, _ in held])
    truth = np.array([y for _, _, y in held])

    def loss(temperature: float) -> float:
        p = LanguageModel(languages, table, temperature, 0).probabilities(scores)
        return float(-np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean())

    temperature = min((float(t) for t in np.geomspace(0.05, 20, 61)), key=loss)
    p = LanguageModel(languages, table, temperature, 0).probabilities(scores)
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-best, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(precision >= WANTED_PRECISION)
    threshold = float(best[order][enough[-1]]) if len(enough) else 1.0
    return LanguageModel(languages, table, temperature, threshold)


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    per_language: int = PER_LANGUAGE,
) -> LanguageModel | None:
    """Fit on about ``per_language`` whole texts of each language; ids only choose the sample.

    Rows without text or language teach nothing; None if nothing is left.
    """
    rows = labelled.select(
        column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).cast("string").alias("lang")
    )
    sample, _ = stratified(rows.where("text IS NOT NULL"), "lang", "id", per_language)
    found = sorted((r.lang, r.text) for r in sample.select("lang", "text").collect())
    return fit([t for _, t in found], [y for y, _ in found])


def predicted(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected, from every whole text.

    A text that is NULL or has no letter gets ``und``, score 0, and is rejected, as does
    every text if there is no model. Below the model's threshold a prediction stays but
    is marked rejected. New columns are lengthened where the table has such names. Rows
    stay as they are, repeated ones too.
    """
    names = [free_name(docs, n) for n in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            whole = pc.fill_null(text.cast(pa.large_string()), "")
            letters = np.array([LETTER.search(t) is not None for t in whole.to_pylist()], bool)
            offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
            raw = whole.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            best, score = np.zeros(len(whole), np.int64), np.zeros(len(whole))
            if model is not None and len(whole):
                p = model.probabilities(model.scores(data, offsets))
                best, score = p.argmax(axis=1), p.max(axis=1)
            letters &= model is not None
            languages = np.array([*(model.languages if model else ()), UNKNOWN], object)
            best = np.where(letters, best, len(languages) - 1)
            score = np.where(letters, score, 0.0)
            rejected = ~letters | (score < (model.threshold if model else 0))
            added = [pa.array(languages[best], pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    kinds = zip(names, (F.lit(""), F.lit(0.0), F.lit(False)), strict=True)
    return docs.mapInArrow(run, docs.select("*", *[v.alias(n) for n, v in kinds]).schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter of them is never learned from."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    found = predicted(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
