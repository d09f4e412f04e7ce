"""Documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept, is written as Parquet and read again. All but the
last return the columns of ``documents``. Every stage takes null and empty texts, repeated rows, empty
tables and further columns as its operator states them:

* language: a text that is null, has no letter or is far from all learned languages goes;
* near_duplicates: one document of each class of linked fingerprints stays, the smallest doc_id;
* secrets: a document in which a secret is found goes, all others stay as they are;
* mix: whole documents as often as the mix takes words from them, none without words;
* packing: pieces in sequences of 2048 tokens, with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapgrade.llm import language, mixing, packing, secrets, simhash
from snapgrade.llm.registry import share_library
from snapgrade.session import materialise


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_library(spark)
    return language.known_language(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_library(spark)
    return simhash.keep_one_per_class(docs)


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_library(spark)
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_library(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_library(spark)
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("secrets", drop_secrets),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

# A learned classifier, a tokenizer and a hash that SQL lacks: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
