"""Pack an arriving stream of encoded documents, carrying unfinished rows over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foretoken.operators.packing import wrapped_rows

ROW_SCHEMA = "shard INT, sample BIGINT, tokens ARRAY<INT>, complete BOOLEAN"
CARRY_SCHEMA = "shard INT, total BIGINT, last BIGINT, ids ARRAY<INT>"
DOCUMENT_SCHEMA = "shard INT, doc_id BIGINT, ids ARRAY<INT>, n INT, since BIGINT"
# Micro-batches that an early document waits for those before it.
PATIENCE = 8


def _rows_path(path: str, batch_id: int) -> str:
    return f"{path}/rows/batch_id={batch_id}"


def _carry_path(path: str, batch_id: int) -> str:
    return f"{path}/carry/batch_id={batch_id}"


def _held_path(path: str, batch_id: int) -> str:
    return f"{path}/held/batch_id={batch_id}"


def _late_path(path: str, batch_id: int) -> str:
    return f"{path}/late/batch_id={batch_id}"


def pack_micro_batch(
    encoded: DataFrame,
    batch_id: int,
    path: str,
    row_length: int,
    step: int | None = None,
    patience: int = PATIENCE,
) -> None:
    """Pack one micro-batch after the rows the one before it left unfinished.

    What is carried is fewer than ``row_length`` ids and a total per shard. Each micro-batch reads
    the carry of the last and writes its own, so delivering one again gives the same rows. A large
    shard is spread over tasks as in the batch job, which one state per shard could not be.

    Without ``step`` the documents of a shard must arrive in the order of their ids; one that does
    not is an error. With it, the ids of a shard are ``shard, shard + step, …``, as ``read_documents``
    deals them among ``step`` shards, and documents may arrive in any order: those before the first
    missing id are packed, the others are held. When a document has waited for ``patience`` further
    micro-batches, the ids missing before it are given up: it and all held ones before it are
    packed. What arrives after its place was passed, repeats included, goes to ``late_documents``
    and is packed nowhere. So what is held came with the last ``patience`` micro-batches.
    """
    spark = encoded.sparkSession
    if batch_id:
        carry = spark.read.schema(CARRY_SCHEMA).parquet(_carry_path(path, batch_id - 1))
    else:
        carry = spark.createDataFrame([], CARRY_SCHEMA)
    if step is None:
        _require_order(encoded, carry)
    else:
        encoded = _in_turn(encoded, carry, batch_id, path, step, patience)
    rows_path = _rows_path(path, batch_id)
    (
        wrapped_rows(encoded, row_length, carry)
        .withColumn("complete", F.size("tokens") == row_length)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("complete")
        .parquet(rows_path)
    )
    unfinished = (
        spark.read.schema(ROW_SCHEMA)
        .parquet(rows_path)
        .where(~F.col("complete"))
        .select("shard", F.col("tokens").alias("ids"))
    )
    totals = (
        encoded.select(
            "shard", F.col("n").cast("bigint").alias("total"), F.col("doc_id").alias("last")
        )
        .unionByName(carry.select("shard", "total", "last"))
        .groupBy("shard")
        .agg(F.sum("total").alias("total"), F.max("last").alias("last"))
    )
    (
        totals.join(unfinished, "shard", "left")
        .select(
            "shard", "total", "last", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
        )
        .write.mode("overwrite")
        .parquet(_carry_path(path, batch_id))
    )


def _in_turn(
    arrived: DataFrame, carry: DataFrame, batch_id: int, path: str, step: int, patience: int
) -> DataFrame:
    """The documents that nothing is missing before; writes the ones held and the ones too late.

    Only shards and numbers are shuffled, to find where ids are missing; documents stay in place.
    """
    spark = arrived.sparkSession
    columns = ["shard", "doc_id", "ids", "n", "since"]
    known = arrived.withColumn("since", F.lit(batch_id).cast("bigint")).select(columns)
    if batch_id:
        held = spark.read.schema(DOCUMENT_SCHEMA).parquet(_held_path(path, batch_id - 1))
        known = known.unionByName(held)
    # One row for each shard, here and below.
    passed = carry.select("shard", F.col("last").alias("_last"))
    placed = known.join(F.broadcast(passed), "shard", "left")
    is_late = F.coalesce(F.col("doc_id") <= F.col("_last"), F.lit(False))
    numbers = placed.where(~is_late).select("shard", "doc_id", "since", "_last")
    waited = F.when(F.col("since") <= batch_id - patience, F.col("doc_id"))
    floors = numbers.groupBy("shard").agg(
        F.greatest(
            F.coalesce(F.max("_last"), F.first("shard") - F.lit(step)).cast("bigint"), F.max(waited)
        ).alias("_floor")
    )
    before = numbers.select(
        F.col("shard").alias("_shard"), (F.col("doc_id") + step).alias("_next")
    )
    after_gap = numbers.join(
        before, (F.col("shard") == F.col("_shard")) & (F.col("doc_id") == F.col("_next")), "left_anti"
    )
    stops = (
        after_gap.join(F.broadcast(floors), "shard")
        .where((F.col("doc_id") > F.col("_floor")) & (F.col("doc_id") != F.col("_floor") + step))
        .groupBy("shard")
        .agg(F.min("doc_id").alias("_stop"))
    )
    cut = placed.join(F.broadcast(stops), "shard", "left")
    early = ~is_late & F.coalesce(F.col("doc_id") >= F.col("_stop"), F.lit(False))
    for rows, target in (
        (cut.where(early), _held_path(path, batch_id)),
        (placed.where(is_late), _late_path(path, batch_id)),
    ):
        rows.select(columns).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return cut.where(~is_late & ~early).select("shard", "doc_id", "ids", "n")


def _require_order(encoded: DataFrame, carry: DataFrame) -> None:
    """Raise if a shard's documents arrive after one with a larger id."""
    first = encoded.groupBy("shard").agg(F.min("doc_id").alias("first"))
    late = first.join(carry, "shard").where(F.col("first") <= F.col("last"))
    # At most one row for each shard.
    found = late.select("shard", "first", "last").orderBy("shard").limit(20).collect()
    if found:
        told = ", ".join(f"{first} after {last} in shard {shard}" for shard, first, last in found)
        raise ValueError(f"documents arrived late: {told}")


def start_packing(
    encoded: DataFrame,
    path: str,
    checkpoint: str,
    row_length: int,
    step: int | None = None,
    patience: int = PATIENCE,
) -> StreamingQuery:
    """Pack whatever has arrived, then stop; see ``pack_micro_batch``."""
    return (
        encoded.writeStream.foreachBatch(
            lambda batch, batch_id: pack_micro_batch(
                batch, batch_id, path, row_length, step, patience
            )
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def release_held(spark: SparkSession, path: str, row_length: int, step: int) -> None:
    """Pack the documents still held after the last micro-batch, whatever is missing before them.

    They are packed as one micro-batch more. Should the stream go on after all, its next micro-batch
    replaces that one, and they are held again.
    """
    carries = spark.read.schema(CARRY_SCHEMA + ", batch_id BIGINT").parquet(f"{path}/carry")
    last = carries.agg(F.max("batch_id")).first()[0]
    if last is not None:
        nothing = spark.createDataFrame([], DOCUMENT_SCHEMA).drop("since")
        pack_micro_batch(nothing, last + 1, path, row_length, step, patience=0)


def late_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents that arrived after their place was passed, with the micro-batch they came in."""
    return (
        spark.read.schema(DOCUMENT_SCHEMA + ", batch_id BIGINT")
        .parquet(f"{path}/late")
        .select("shard", "doc_id", "ids", "n", "batch_id")
    )


def packed_rows(spark: SparkSession, path: str) -> DataFrame:
    """The finished rows of all micro-batches."""
    return (
        spark.read.schema(ROW_SCHEMA + ", batch_id INT")
        .parquet(f"{path}/rows")
        .where("complete")
        .select("shard", "sample", "tokens")
    )
