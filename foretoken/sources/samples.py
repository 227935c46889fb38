"""The table of token rows: write, read, cap and batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretoken.functions.ids import whole_part

# Ids that one counting task reads: it may hold an n-gram for each. Rows move in runs of neighbours of
# so many ids, which share n-grams and batches.
TASK_IDS = 1 << 22
RUN_IDS = 1 << 15
# Ids of a task that holds both the partial and the final counts of whole batches.
GATHERED_IDS = TASK_IDS // 2

SAMPLE_SCHEMA = "sample BIGINT, tokens ARRAY<INT>, shard INT"


def write_samples(samples: DataFrame, path: str, keep_others: bool = False) -> None:
    """One folder per shard. A rebalance keeps files near the advisory size: small shards get one
    file, a shard that outgrows it is split over several tasks. ``keep_others``: replace only the
    shards that are written; otherwise the whole table."""
    (
        samples.hint("rebalance", "shard")
        .sortWithinPartitions("shard", "sample")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if keep_others else "static")
        .option("compression", "zstd")
        .partitionBy("shard")
        .parquet(path)
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMA).parquet(path).select("shard", "sample", "tokens")


def read_sample_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(SAMPLE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).select("shard", "sample", "tokens")


def spread_samples(samples: DataFrame, row_length: int) -> DataFrame:
    """The same rows in tasks of about ``TASK_IDS`` ids. Files of compressed ids come in splits of
    many times that, and a task's table of n-grams would grow with them. Rows that arrive in enough
    splits stay; ``samples`` is counted, so it should be a table on storage."""
    parts = -(-samples.count() * row_length // TASK_IDS)
    if samples.rdd.getNumPartitions() >= parts:
        return samples
    return samples.repartition(parts, "shard", whole_part("sample", max(1, RUN_IDS // row_length)))


def batch_fits_a_task(row_length: int, batch_size: int, n_shards: int) -> bool:
    """Whether all rows of a batch, from every shard, are few enough for one counting task."""
    return n_shards * batch_size * row_length <= GATHERED_IDS


def gather_batches(samples: DataFrame, row_length: int, batch_size: int) -> DataFrame:
    """The same rows with their ``batch``, all of a batch in one task, so that counts by batch move rows
    of ids once and no n-gram. ``samples`` is counted, so it should be a table on storage."""
    parts = -(-samples.count() * row_length // GATHERED_IDS)
    return with_batch(samples, batch_size).repartition(max(1, parts), "batch")


def cap_per_shard(samples: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows of every shard; row numbers are dense, so this is a pushed-down filter."""
    return samples if n is None else samples.where(F.col("sample") < n)


def with_batch(samples: DataFrame, batch_size: int) -> DataFrame:
    return samples.withColumn("batch", whole_part("sample", batch_size))


def cap_batches(samples: DataFrame, batch_size: int, batches: int | None) -> DataFrame:
    """The first ``batches`` batches of every shard, all of them if None."""
    limited = cap_per_shard(samples, None if batches is None else batches * batch_size)
    return with_batch(limited, batch_size)
