"""Stand-in views over the driver's tables, as Spark and as SQL, from the same expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def end() -> Column:
    """The window's end of the stand-in items."""
    return F.lit("2024-01-03 00:00:00").cast("timestamp")


ITEMS = """
items AS (SELECT CAST(doc_id AS VARCHAR) AS item_key, source AS source_id, source AS source_name, lang AS language,
  'R' || CAST(CAST(substring(source, 4) AS INTEGER) % 5 AS VARCHAR) AS region, substring(text, 1, 80) AS title, substring(text, 81) AS summary,
  'doc://' || CAST(doc_id AS VARCHAR) AS source_url,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 7919) % 2880 AS INTEGER)) AS published_at,
  TIMESTAMP '2024-01-03 00:00:00' AS fetched_at FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out to all cores if it has fewer parts than there are cores, as a file of one row group has; a table of
    many files stays as it is. For scans only: counting the parts of other plans would run them."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of(spread(table(spark, sf_dir, "documents")))


def items_of(documents: DataFrame) -> DataFrame:
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return documents.select(
        F.col("doc_id").cast("string").alias("item_key"), F.col("source").alias("source_id"), F.col("source").alias("source_name"), F.col("lang").alias("language"),
        F.concat(F.lit("R"), (F.substring("source", 4, 10).cast("int") % 5).cast("string")).alias("region"),
        F.substring("text", 1, 80).alias("title"), F.expr("substring(text, 81)").alias("summary"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_url"),
        F.timestamp_seconds(start + (F.col("doc_id") * 7919) % 2880 * 60).alias("published_at"), end().alias("fetched_at"),
    )
