"""Shared plumbing of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import broadcast_if_small, delete, materialize, partitions, ranked, scratch_path, shared_dir

__all__ = ["broadcast_if_small", "delete", "materialize", "partitions", "ranked", "scratch_path", "shared_dir", "size_words", "table"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_words(text: str = "text") -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
