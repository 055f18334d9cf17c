"""A training-corpus pipeline over ``documents``: five stages, each written and read again.

All but the last stage pass every column through, of any name. Null ids, texts and sources are values like others,
rows that repeat an id are rows of their own, and an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosodia.llm import decontaminate, mixing, ngram_join, token_ids, toxicity
from prosodia.llm.queries import tokenizer_file
from prosodia.llm.shared import materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on labels, finds toxic go; null and empty texts stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles at similarity 0.8 link stays: the least doc_id; those without words all stay."""
    return ngram_join.keep_first(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or nearly, go; null and empty texts stay."""
    return decontaminate.keep_untouched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; those without words fill no share and aren't taken."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document; a null text has its end id alone."""
    return token_ids.token_table(docs, tokenizer_file(), end_id=2)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_ids", tokens),
]

#: SQL cannot express the first and last stages; tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
