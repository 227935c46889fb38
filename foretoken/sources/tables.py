"""Catalogue tables on storage, laid out by the chunk of their first id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretoken.operators.ngrams import with_chunk
from foretoken.session import list_folder, remove_folder
from foretoken.sources.samples import TASK_IDS


def write_table(table: DataFrame, path: str) -> None:
    """Create or replace a table."""
    table.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_ranked(ordered: DataFrame, path: str) -> DataFrame:
    """Write a globally sorted table and read it back with the place of each row, ``rank``, from 1.

    Sorting leaves ranges of rows in numbered partitions, so a rank is the sizes of the partitions
    before and the place inside: no task sees more than one range.
    """
    spark = ordered.sparkSession
    write_table(ordered.withColumn("_place", F.monotonically_increasing_id()), path)
    placed = spark.read.parquet(path)
    part = F.shiftright("_place", 33)
    # One row for each partition.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_part"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, part == F.col("_part")).select(
        *ordered.columns, (F.col("_start") + inside + 1).alias("rank")
    )


def write_partials(partials: DataFrame, path: str, gathered: bool = False) -> None:
    """Partial counts in one folder for each batch, by chunk inside: a folder for each batch and chunk
    would hold a few rows. ``gathered``: all of a batch are in one task already. All that an earlier run left of the batches named in the data goes first,
    so a rerun counts no batch twice, whatever chunks it fills."""
    spark = partials.sparkSession
    there = {name for name in list_folder(spark, path) if name.startswith("batch=")}
    if there:
        # One number for each batch.
        for row in partials.select("batch").distinct().collect():
            if f"batch={row.batch}" in there:
                remove_folder(spark, f"{path}/batch={row.batch}")
    ids = [c for c in partials.columns if c.startswith("id") and c[2:].isdigit()]
    (
        (partials if gathered else partials.hint("rebalance", "batch"))
        .sortWithinPartitions("batch", "id0_chunk", *ids)
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy("batch")
        .parquet(path)
    )


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """Partial counts of all batches, many small files to a task: one n-gram of many batches leaves the
    task once. At least a task for each core."""
    partials = spark.read.parquet(path)
    tasks = max(-(-partials.count() // TASK_IDS), spark.sparkContext.defaultParallelism)
    return partials.coalesce(tasks)


def write_chunked(counts: DataFrame, path: str, chunks: int, order: list | None = None) -> None:
    """One folder per chunk. The rebalance writes one file per chunk up to the session's advisory
    partition size and splits a chunk that is larger, such as that of a very frequent first id."""
    ids = [c for c in counts.columns if c.startswith("id") and c[2:].isdigit()]
    (
        with_chunk(counts, chunks)
        .hint("rebalance", "id0_chunk")
        .sortWithinPartitions("id0_chunk", *(order or ids))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("id0_chunk")
        .parquet(path)
    )


def read_chunks(spark: SparkSession, path: str, chunk: int | None = None) -> DataFrame:
    """The whole table, or one chunk of it: a partition filter, so other folders are not opened."""
    table = spark.read.parquet(path)
    return table if chunk is None else table.where(F.col("id0_chunk") == chunk)


def union_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Chunk tables put together, where they do not already share a folder."""
    whole = chunks[0]
    for chunk in chunks[1:]:
        whole = whole.unionByName(chunk)
    return whole
