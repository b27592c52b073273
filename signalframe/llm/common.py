"""Shared input handling of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrowed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns alone, so that other columns can't clash. A null text becomes empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more
    )


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int = 16 << 20, sized_by: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of text, so that a worker holds little at once."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(sized_by))
        each = max(1, int(batch.num_rows * max_bytes / max(1, column.nbytes)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


class Memory(dict):
    """key -> make(key), remembering the last ``most`` to twice as many keys."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got
