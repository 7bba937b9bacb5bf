"""Five stages over documents; each is one operator of limen.llm and works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limen.llm import exact_dedup, jaccard, packing, substring, toxicity
from limen.llm.common import saved, table
from limen.llm.queries import tokenizer_file


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is fitted on the labelled rows among them."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.drop_exact(docs)


def distinct_sets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles, the one with the smallest id."""
    return jaccard.keep_one(docs, n=5, percent=75)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of 20 words or passages of 50 that an earlier one has; n_chars follows the text."""
    cut = substring.without_repeats(docs, unit="line", least=20, window=15)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard", distinct_sets),
    ("substring_dedup", distinct_passages),
    ("best_fit_packing", packed_sequences),
]

#: No SQL: a trained model and a tokenizer are among the stages; tests/llm/test_pipeline.py chains plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
