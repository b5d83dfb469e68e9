"""A training corpus from `documents`: five stages, each over all that the stage before it kept.

language ID -> near-duplicates -> decontamination -> mixing -> token files. Every stage is a function of
(spark, docs, sf_dir) and is written as a table that the next stage reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbtrace.llm import decontaminate, language, mixing, near_duplicates, token_frames
from plumbtrace.llm.common import ship, table
from plumbtrace.llm.queries import tokenizer_path
from plumbtrace.sources.scratch import materialise



def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels know stay; texts that are null or have no letter go."""
    ship(spark)
    model = language.train_language_model(docs)
    found = language.predict_language(F.col("text"), model, spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), found.alias("language"))
    return rows.where(F.col("language.lang_pred") != language.UNDETERMINED).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship(spark)
    return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item contaminates go."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus; their documents in order: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    return token_frames.token_digest(docs, tokenizer_path())


STAGES = [
    ("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontaminate", drop_contaminated),
    ("mix", mix_sources), ("token_files", write_token_files),
]

#: The network, the signatures and the tokenizer are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"corpus_{name}")
    return docs
