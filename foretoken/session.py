"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import SparkSession


# Bytes of source per shuffle partition, and the range of their number.
PARTITION_BYTES = 256 << 20
PARTITIONS = (200, 100_000)


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions for a corpus: n-gram shuffles are about as large as its text, and
    adaptive execution merges the ones that turn out small."""
    least, most = PARTITIONS
    return max(least, min(most, input_bytes // PARTITION_BYTES))


def build_session(
    app: str = "foretoken", master: str | None = None, input_bytes: int = 0, **conf: str
) -> SparkSession:
    """A session with adaptive execution, skew handling and Arrow transfer switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions(input_bytes)),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, removed when the driver ends.

    It lies below the folder named in ``spark.checkpoint.dir``, or else below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    parent = named or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{parent.rstrip('/')}/foretoken-{uuid.uuid4().hex}"
    atexit.register(_remove_if_possible, spark, folder)
    return folder


def _remove_if_possible(spark: SparkSession, folder: str) -> None:
    # At exit the JVM may be gone already.
    with contextlib.suppress(Exception):
        remove_folder(spark, folder)


def _file_system(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.sc().hadoopConfiguration()), path


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete ``folder`` through Spark's file system; a session that has ended leaves it."""
    if spark.sparkContext._jsc is None:
        return
    system, path = _file_system(spark, folder)
    system.delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    system, path = _file_system(spark, folder)
    return system.exists(path)


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, path = _file_system(spark, folder)
    if not system.exists(path):
        return []
    return [status.getPath().getName() for status in system.listStatus(path)]


def read_file(spark: SparkSession, name: str) -> str:
    """A small text file."""
    system, path = _file_system(spark, name)
    stream = system.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_file(spark: SparkSession, name: str, text: str) -> bool:
    """Write a small text file that is there as a whole or not at all; False if there is one."""
    system, path = _file_system(spark, name)
    if system.exists(path):
        return False
    _, draft = _file_system(spark, f"{path.getParent()}/.draft-{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if system.rename(draft, path):
        return True
    system.delete(draft, True)
    return False
