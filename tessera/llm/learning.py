"""Folds and bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def labelled_sample(labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """At most `most` labelled ids outside the held-out fold, those with the smallest hashes: a top-k, so of bounded size."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(modulus) != held))
    one = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
