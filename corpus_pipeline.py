"""A corpus for training: toxic texts go, then exact and near copies; sources are mixed, texts encoded.

Each stage takes the documents its predecessor kept, whole, and all but the last return documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnout.llm import bpe, exact_dedup, mixing, simhash, toxicity
from turnout.llm.common import configure, stored
from turnout.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on the labelled ones does not call toxic."""
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that is equal but for white space, the longest one."""
    configure(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group whose fingerprints of three-word shingles are linked within three bits."""
    configure(spark)
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix asks for."""
    configure(spark)
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every text of the mix."""
    configure(spark)
    return bpe.round_trip(docs, bpe.Vocabulary(vocabulary_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

# Fitted trees and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result a stored table before the next stage reads it."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
