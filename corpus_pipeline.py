"""A corpus pipeline of five stages: each works on all that its predecessor kept, and is written before the next begins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.llm import decontaminate, language_id, ngram_join, packing, secrets
from molquarry.llm.common import own_dir
from molquarry.llm.queries import tokenizer_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, no letter) go."""
    return language_id.keep_identified(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles with a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return ngram_join.keep_first(docs, n=5, num=80, den=100)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return decontaminate.remove_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark."""
    return secrets.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a sequence for each piece of each document."""
    return packing.pack(packing.pieces_of(docs, tokenizer_path()))


STAGES = [
    ("language_id", identify_languages),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The stages learn, cluster and tokenise: SQL cannot express them; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
