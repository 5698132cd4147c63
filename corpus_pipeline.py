"""The corpus pipeline: toxic documents go, one of each group of near copies
stays, benchmark passages go, sources are mixed, and the rest is token blocks.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from tablejobs.llm import containment, mixing, similar, tokens, toxicity
from tablejobs.llm.queries import toxicity_model
from tablejobs.session import load_table, materialize


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, sf_dir), threshold=0.7)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return containment.drop_contaminated(docs, load_table(spark, sf_dir, "benchmark"), threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def write_token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("toxicity", remove_toxic),
    ("near copies", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token blocks", write_token_blocks),
]

#: A vector search over examples, MinHash and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
