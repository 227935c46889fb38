"""Which shards are done, which are missing, and building the ones still to do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretoken.session import folder_exists, remove_folder
from foretoken.sources.samples import write_samples
from foretoken.sources.versions import live_number, live_state, switch

FINISHED = "finished"


def all_shards(spark: SparkSession, n_shards: int) -> DataFrame:
    return spark.range(n_shards).select(F.col("id").cast("int").alias("shard"))


def pending(keys: DataFrame, manifest: DataFrame, key: str = "shard") -> DataFrame:
    """Keys without a finished entry."""
    return keys.join(manifest.where(F.col("status") == FINISHED), key, "left_anti")


def missing(expected: DataFrame, present: DataFrame, key: str = "shard") -> DataFrame:
    """Expected keys that have no rows."""
    return expected.join(present.select(key).distinct(), key, "left_anti")


def require_complete(expected: DataFrame, present: DataFrame, key: str = "shard") -> DataFrame:
    """``present``, or an error that names missing keys."""
    absent = missing(expected, present, key)
    count = absent.count()
    if count:
        first = [row[0] for row in absent.orderBy(key).limit(20).collect()]
        raise ValueError(f"{count} missing from {key}, first of them {first}")
    return present


def read_manifest(spark: SparkSession, path: str, key: str = "shard INT") -> DataFrame:
    """What earlier runs finished; empty where none wrote a manifest."""
    schema = f"{key}, status STRING"
    if folder_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def mark_finished(spark: SparkSession, path: str, keys: list, key: str = "shard INT") -> None:
    """Note keys as finished, once what they stand for is committed."""
    rows = [(*(k if isinstance(k, tuple) else (k,)), FINISHED) for k in keys]
    done = spark.createDataFrame(rows, f"{key}, status STRING")
    done.coalesce(1).write.mode("append").parquet(path)


def build_pending_shards(
    documents: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    samples_path: str,
    manifest_path: str,
    n_shards: int,
    shards_per_job: int | None = None,
    jobs: int | None = None,
) -> int:
    """Build and write the shards that no earlier run finished; return how many.

    A job builds ``shards_per_job`` shards, by default all that are left; ``jobs`` limits how many
    run now. Shards are marked only after their rows are committed, and writing a shard again
    replaces it.
    """
    spark = documents.sparkSession
    # At most n_shards small rows.
    todo = sorted(
        row.shard
        for row in pending(
            all_shards(spark, n_shards), read_manifest(spark, manifest_path)
        ).collect()
    )
    size = shards_per_job or max(1, len(todo))
    parts = [todo[i : i + size] for i in range(0, len(todo), size)][:jobs]
    for part in parts:
        write_samples(
            build(documents.where(F.col("shard").isin(part))), samples_path, keep_others=True
        )
        mark_finished(spark, manifest_path, part)
    return sum(map(len, parts))


def reads_files(documents: DataFrame) -> bool:
    try:
        documents.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def shard_states(documents: DataFrame) -> dict[int, str]:
    """For each shard that has documents, a number that changes with the files that hold them, or,
    for documents that come from no file, with the rows.

    One job, which reads the shard's column and no text; the driver gets a row for each shard.
    """
    if reads_files(documents):
        facts = ["file_path", "file_size", "file_modification_time"]
        seen = documents.select("shard", *[f"_metadata.{fact}" for fact in facts]).distinct()
    else:
        facts = [c for c in documents.columns if c != "shard"]
        seen = documents
    mixed = F.bit_xor(F.xxhash64(*[seen[fact] for fact in facts])).alias("mixed")
    states = seen.groupBy("shard").agg(F.count("*").alias("n"), mixed)
    return {row.shard: f"{row.n} {row.mixed}" for row in states.collect()}


def build_changed_shards(
    documents: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    samples_path: str,
    manifest_path: str,
    made_from: dict[int, str],
    shards_per_job: int | None = None,
) -> list[int]:
    """Build and write the shards whose rows were not made from what ``made_from`` names, remove
    those that it does not name, and return the shards built.

    The manifest says what the rows of each shard were made from. A shard is struck off before its
    rows are touched and noted after they are committed, so a build that ends in between is done
    again whatever the documents are then.
    """
    spark = documents.sparkSession
    seen = live_number(spark, manifest_path)
    held = live_state(spark, manifest_path, seen) or {}

    def note(state: dict[str, str]) -> None:
        nonlocal seen, held
        switch(spark, manifest_path, seen, state, lambda _: [])
        seen, held = seen + 1, state

    def strike(shards: list[int]) -> None:
        note({k: v for k, v in held.items() if int(k) not in set(shards)})
        for shard in shards:
            # A shard may have no rows this time.
            remove_folder(spark, f"{samples_path}/shard={shard}")

    gone = sorted(int(k) for k in held if int(k) not in made_from)
    if gone:
        strike(gone)
    todo = sorted(s for s, state in made_from.items() if held.get(str(s)) != state)
    size = shards_per_job or max(1, len(todo))
    for k in range(0, len(todo), size):
        part = todo[k : k + size]
        strike(part)
        # All of them: no filter on the shard, which would only cost.
        rows = documents if len(part) == len(made_from) else documents.where(F.col("shard").isin(part))
        write_samples(build(rows), samples_path, keep_others=True)
        note({**held, **{str(s): made_from[s] for s in part}})
    return todo
