"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``. A stage begins when the result of the one before has been
written; the tables that were only steps towards that are deleted then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from spokeframe.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from spokeframe.llm.tables import column, dropped, kept, noted, read_table
from spokeframe.llm.vocabulary import public_path

#: Steps of the last stage that began, by application and folder of data.
_LEFT: dict[tuple[str, str], list[str]] = {}


def _stage(function: Callable) -> Callable:
    """Deletes what the stage before left, and notes what this one leaves."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_of = (spark.sparkContext.applicationId, sf_dir)
        dropped(spark, _LEFT.pop(run_of, []))
        with noted() as paths:
            found = function(spark, docs, sf_dir)
        _LEFT[run_of] = paths
        return found

    return run_stage


@_stage
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not find toxic."""
    found = toxicity.scored(docs, toxicity.learned(spark, sf_dir, docs))
    verdict = found.columns[-1]
    return found.where(column(verdict) == 0).select([column(c) for c in docs.columns])


@_stage
def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id."""
    return exact_dedup.deduplicated(docs)


@_stage
def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked from a similarity of 0.8 on."""
    return near_dedup.deduplicated(docs)


@_stage
def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 100 bytes or more that occur earlier."""
    return suffix_dedup.deduplicated(docs)


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces packed into sequences of at most 2048 ids."""
    return packing.packed(kept(packing.pieces(docs, public_path("word_bpe_49k.json")), "pieces"))


STAGES = [
    ("toxicity", not_toxic),
    ("exact dedup", distinct_texts),
    ("near dedup", no_near_copies),
    ("suffix-array dedup", no_repeated_passages),
    ("best-fit packing", sequences),
]

#: Learned weights, sketches and best fit are beyond SQL; the three dedup stages are tested in their chain
#: against brute force, toxicity and packing by their own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
