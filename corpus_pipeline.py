"""Corpus preparation: five of the corpus operators in a row over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept.
All but the last return rows of ``documents`` with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firnline.llm import decontamination, exact_dedup, ngram_join, sentencepiece, toxicity
from firnline.llm.columns import read_table
from firnline.llm.token_counts import vocabulary_path
from firnline.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labelled rows, does not reject."""
    labels = toxicity.training_rows(read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, toxicity.learn(toxicity.training_rows(docs), labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts."""
    return ngram_join.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without noteworthy passages of the benchmark."""
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return sentencepiece.encode(docs, sentencepiece.read_model(vocabulary_path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_texts),
]

#: SQL can say neither the grammar nor the encoding; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
