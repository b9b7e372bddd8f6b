"""The corpus pipeline: quality, near-duplicates, secrets, mixture, token ids.

Every stage takes all documents that the one before kept, acts on them and
returns the columns of documents; the last returns token ids.  Each result is
written as Parquet in the shared folder and read again, so a lost executor
costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, minhash, mixing, quality, secrets
from quarry.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's outlier test reject go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity 0.8."""
    return minhash.dedup(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of texts and a mark is left; no document goes."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources have their target weights."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hashes of the ids and of the text decoded from them."""
    return bpe.encode(docs, digest=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: Trained models, components and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
