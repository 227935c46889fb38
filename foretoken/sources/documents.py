"""Text sources, divided into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shard(key: str, n_shards: int):
    return F.pmod(F.col(key), F.lit(n_shards)).cast("int").alias("shard")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Shuffle a source that arrives in fewer splits than there are cores; leave others alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= 2 * cores:
        return rows
    return rows.repartition(2 * cores, key)


def read_documents(
    spark: SparkSession, path: str, n_shards: int, extra: tuple[str, ...] = (), spread: bool = True
) -> DataFrame:
    """``(shard, doc_id, text, *extra)`` from a Parquet table; only these columns are read.

    ``doc_id`` is a BIGINT, different for every document, and sets their order.
    """
    table = spark.read.parquet(path).select("doc_id", "text", *extra)
    if spread:
        table = _spread(table, "doc_id")
    return table.select(_shard("doc_id", n_shards), "doc_id", "text", *extra)


def read_conversations(spark: SparkSession, path: str, n_shards: int) -> DataFrame:
    """The turns of conversations as documents, in the order of conversation and turn.

    A document's number is its place in the sorted table, with gaps between the sorted ranges, so
    any turn of any conversation has one, and a long conversation is spread over ranges.
    """
    table = spark.read.parquet(path).select("conv_id", "turn", "text").orderBy("conv_id", "turn")
    numbered = table.select(
        _shard("conv_id", n_shards), F.monotonically_increasing_id().alias("doc_id"), "text"
    )
    return numbered


def shard_range(rows: DataFrame, n_shards: int, begin: int = 0, end: int = -1) -> DataFrame:
    """The shards in ``[begin, end)``; an end of -1 or past the last shard means all of them."""
    stop = n_shards if end == -1 else min(end, n_shards)
    return rows.where((F.col("shard") >= begin) & (F.col("shard") < stop))


def shard_row_counts(rows: DataFrame) -> DataFrame:
    """Rows per shard next to the expected total."""
    counts = rows.groupBy("shard").agg(F.count("*").alias("n_rows"))
    # One row per shard by now.
    return counts.withColumn("total_rows", F.sum("n_rows").over(Window.partitionBy()))
