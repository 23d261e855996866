"""From documents to token files in five stages, each an operator of `tidemark.llm` over all that the one before kept.

Every stage's rows are written as Parquet into the shared folder and read again as the next stage's documents. All but the
last return the columns of `documents`, whatever further ones there are and however they are named. Null ids are kept and
come last; null and empty texts pass every stage but the mix, which takes no empty text; rows that repeat id and text are
one document from the second stage on. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, ngram_join, quality, token_files
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import stored

#: Documents under this probability of good quality are rejected.
KEEP_FROM = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, KEEP_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each class stays: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.one_of_each_class(docs, ngram_join.SetSpec(words=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixture(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written; (doc_id, start, n_tokens, ids_crc32) as read back from them."""
    return token_files.read_tokens(token_files.write_tokens(docs, tokenizer_path()))


STAGES = [
    ("quality", classify),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("tokens", token_output),
]

#: Learnt decisions, exact set similarity over all pairs and tokenization are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
