"""A corpus pipeline of the llm operators: toxicity, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from taskledger.llm.bpe import round_trip_digests
from taskledger.llm.common import shared_folder, table
from taskledger.llm.mixing import in_shards, mixed_documents
from taskledger.llm.secrets import redact
from taskledger.llm.simhash_dedup import keep_one
from taskledger.llm.toxicity import drop_toxic, learn_lexicon


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. The lexicon is learned from the labelled ones among docs."""
    return drop_toxic(docs, learn_lexicon(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group of near-duplicates."""
    return keep_one(docs, radius=3, words=3)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, shard by shard in random order: documents that it takes once, twice, or in part."""
    return in_shards(mixed_documents(docs)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document taken."""
    return round_trip_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL has neither the learned lexicon nor the fingerprints nor the tokenizer; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between them is written to the shared checkpoint folder.

    Rows with null or repeated ids are rows like others: a row is known by its id and text. Null
    texts are empty, and of empty ones, which are copies of each other, one is kept; the mix takes
    words, so a text without any isn't in it. An empty table gives no rows.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
