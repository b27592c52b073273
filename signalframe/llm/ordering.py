"""Passes over documents in doc_id order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import narrowed


def in_order(docs: DataFrame, descending: bool = False) -> DataFrame:
    """doc_id and text, range-partitioned and sorted by doc_id, equal ids by text; partition numbers rise with the order.

    Null doc_ids come last either way. Rows of one doc_id (or none) are cut apart by a hash of the text, equal rows by
    where they stand, so no doc_id makes one task large; equal ids are in order of that hash, then of the text.
    """
    key = F.col("doc_id").desc_nulls_last() if descending else F.col("doc_id").asc_nulls_last()
    numbered = narrowed(docs).select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    return numbered.repartitionByRange(key, "hash", "place").sortWithinPartitions(key, "hash", "text").select("doc_id", "text")
