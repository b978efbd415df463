"""Corpus pipeline: the stages a document passes before it is tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the documents it keeps with the columns of ``documents``; the last
returns tokens.  A stage trains and counts over the documents it is given and
works on all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import benchmark, pieces, secrets, simhash, toxicity
from sitelens.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained chain scores 0.5 or more go; all others stay as they are."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates (3-word shingles, at most 2 differing bits): one document of each group stays."""
    return simhash.keep_one(docs, size=3, max_bits=2)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; no document goes."""
    return benchmark.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    return secrets.mask_secrets(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, round_trip of every document."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", hide_secrets),
    ("pieces", to_pieces),
]

#: Trained models are no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written once, as later stages read it more than once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
