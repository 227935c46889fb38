"""What several of these operators need: stored tables, splits by id, ranks inside hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretoken.session import remove_folder, shared_folder

# Rows of one group that a window sorts together; larger groups are salted.
RANK_ROWS = 1 << 16


class Scratch:
    """Tables written below one new shared folder, so that no later job repeats an earlier one."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = shared_folder(spark)
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.folder}/{self._n}-{name}"

    def store(self, rows: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        rows.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        kept.stored_at = path
        return kept

    def drop(self, table: DataFrame) -> None:
        """Delete a stored table that no later job reads."""
        remove_folder(self.spark, table.stored_at)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_fold(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def rank_within(rows: DataFrame, group: str, salt: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0, whatever the size of the group.

    Rows are salted by a hash of the columns ``salt`` into as many buckets as keep one bucket near
    ``RANK_ROWS`` rows, numbered by ``order`` inside (group, bucket), and moved by the sizes of the
    buckets before. ``rows`` must be a stored table: it is read twice.
    """
    n = rows.count()
    buckets = max(8, -(-n // RANK_ROWS))
    salted = rows.withColumn("_bucket", F.pmod(F.xxhash64(*salt), F.lit(buckets)))
    sizes = salted.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_group"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(inside) - 1)
    joined = numbered.join(
        starts, numbered[group].eqNullSafe(starts["_group"]) & (F.col("_bucket") == F.col("_b"))
    )
    return joined.select(*rows.columns, (F.col("_start") + F.col("_row")).cast("bigint").alias(out))
