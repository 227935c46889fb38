"""Vector bin packing of groups of equal texts into shards: bytes, tokens and rows together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch, rank_within

SHARDS = 40
# Bytes that a row takes besides its text.
ROW_BYTES = 16
# Bundles of small groups: one in FINE_SHARE of the hash space is cut as finely as the rest, so that
# the last bundles to be placed are small.
BUNDLES, FINE_SHARE = 4096, 16
# A group larger than the first share of a shard is placed by itself, one larger than the second is
# cut in parts of about that size.
LARGE, SPLIT = 1 / 32, 1 / 4


# How much more the measure of the law counts in the dot product than each of the others.
LAW_WEIGHT = 4.0


def pack_vectors(
    weights: np.ndarray, shards: int, importance: tuple[float, ...] | None = None
) -> np.ndarray:
    """The shard of every unit: largest first, where its dot product with the room left is highest.

    ``weights`` has a row for each unit; every column is scaled to shares of one shard and counts
    by its ``importance``, by default alike. Ties go to the lowest shard.
    """
    totals = weights.sum(axis=0)
    scaled = weights * np.divide(shards, totals, out=np.zeros(len(totals)), where=totals > 0)
    room = np.ones((shards, weights.shape[1]))
    count = np.ones(weights.shape[1]) if importance is None else np.array(importance)
    placed = np.zeros(len(weights), np.int64)
    for unit in np.argsort(-scaled.max(axis=1, initial=0.0), kind="stable"):
        best = int(np.argmax(room @ (count * scaled[unit])))
        placed[unit] = best
        room[best] -= scaled[unit]
    return placed


def shard_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)``: shards of nearly equal bytes.

    A row's vector is its size (UTF-8 bytes of the text and 16), its words and one row. Equal texts
    are a group and share a shard, unless the group is larger than a quarter of a shard: then its
    rows fall into parts of about that size by a hash of their key, each placed like a group. Small
    groups are bundled by a hash of their text, so that the number of units that the driver places
    depends on the number of shards and not on the number of documents.

    A null text has no bytes, no words, a null checksum, and equals other null texts. Null keys and
    repeated rows are placed like others. Other columns are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    raw = F.col(text).cast("binary")
    rows = scratch.store(
        documents.select(
            F.col(key).cast("bigint").alias("key"),
            (F.coalesce(F.octet_length(raw), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("words"),
            F.xxhash64(text, F.octet_length(raw)).alias("group"),
        ).withColumns({"salt": F.xxhash64("key", "group"), "rows": F.lit(1)}),
        "rows",
    )
    vectors = ("size", "words", "rows")
    vector = [F.sum(c).cast("double").alias(c) for c in vectors]
    # One row.
    totals = rows.agg(*vector).first()
    shares = F.greatest(*[F.col(c) / max((totals[c] or 0.0) / shards, 1e-9) for c in vectors])
    # Each takes over LARGE of a shard in one of three measures: at most 3 * shards / LARGE rows.
    large = (
        rows.groupBy("group").agg(*vector).withColumn("share", shares).where(F.col("share") > LARGE)
        .select("group", F.ceil(F.col("share") / SPLIT).cast("bigint").alias("parts")).collect()
    )
    names = spark.createDataFrame([tuple(row) for row in large], "named bigint, parts bigint")
    marked = rows.join(F.broadcast(names), F.col("group") == F.col("named"), "left")
    # Units: (group, part) of a large group; else (-1, bundle).
    spot = F.pmod(F.xxhash64(F.col("group"), F.lit(1)), F.lit(BUNDLES * FINE_SHARE))
    bundle = F.when(spot < BUNDLES, spot + BUNDLES).otherwise(F.floor(spot / FINE_SHARE))
    united = marked.withColumn(
        "unit", F.when(F.col("parts").isNull(), bundle).otherwise(F.pmod("salt", "parts"))
    )
    # At most 2 * BUNDLES rows and the parts of large groups.
    units = sorted(
        united.groupBy("named", "unit").agg(*vector).collect(),
        key=lambda row: (row["named"] is not None, row["named"], row["unit"]),
    )
    weights = np.array([[row[c] for c in vectors] for row in units]).reshape(-1, len(vectors))
    where = spark.createDataFrame(
        [
            (row["named"], row["unit"], int(shard))
            for row, shard in zip(units, pack_vectors(weights, shards, (LAW_WEIGHT, 1.0, 1.0)))
        ],
        "at_named bigint, at_unit bigint, shard int",
    )
    sharded = scratch.store(
        united.join(
            F.broadcast(where),
            F.col("named").eqNullSafe(F.col("at_named")) & (F.col("unit") == F.col("at_unit")),
        ).select("key", "size", "text_crc32", "salt", "shard"),
        "sharded",
    )
    slotted = rank_within(sharded, "shard", ["salt"], ["salt", "key", "size"], "slot")
    return slotted.select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
