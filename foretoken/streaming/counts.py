"""Count n-grams of an arriving stream of token rows, and keep the partial counts few.

Every micro-batch leaves a folder of counts, with their chunk as a column. Whenever ``fan`` neighbouring runs of one level have come
together they are merged into one run of the next level, so that after b micro-batches there are at
most ``fan - 1`` folders for each of about log_fan(b) levels, and a count is written anew once a level,
not once a merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foretoken.functions.ids import id_columns
from foretoken.operators.ngrams import ngram_counts, recombine, with_chunk
from foretoken.session import list_folder, remove_folder
from foretoken.sources.tables import write_table
from foretoken.sources.versions import live_number, live_state, new_folder, switch

BATCH = "batch_id="


def _runs(spark: SparkSession, path: str, number: int | None = None) -> list[dict]:
    """The merged runs, oldest first: level, first and last micro-batch, folder."""
    return live_state(spark, path, number) or []


def _last(runs: list[dict]) -> int:
    return runs[-1]["last"] if runs else -1


def _batches(spark: SparkSession, path: str) -> list[int]:
    names = list_folder(spark, path)
    return sorted(int(name[len(BATCH) :]) for name in names if name.startswith(BATCH))


def write_partial(rows: DataFrame, batch_id: int, n: int, path: str, chunks: int) -> None:
    """Counts of one micro-batch, in a folder of its own: delivering it again replaces it, or does
    nothing once it is part of a merged run."""
    if batch_id <= _last(_runs(rows.sparkSession, path)):
        return
    # A micro-batch is a file or a few, each read by one task or two.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    spread = rows.repartition(cores, "shard", "sample")
    # A folder for each chunk would cost every run a shuffle, a sort and as many files.
    write_table(with_chunk(ngram_counts(spread, n), chunks), f"{path}/{BATCH}{batch_id}")


def _read(spark: SparkSession, path: str, folders: list[str], n: int) -> DataFrame:
    # A micro-batch without rows leaves no file to read a schema from.
    schema = ", ".join([*(f"{c} INT" for c in id_columns(n)), "count BIGINT"])
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)  # chunks are not asked for
    return reader.parquet(*(f"{path}/{f}" for f in folders))


def merge_plan(runs: list[dict], arrived: list[int], fan: int) -> list[dict]:
    """The runs that are to be live after ``arrived`` follow ``runs``; ``sources`` names the folders
    that each is made of. A merge that would fill the next level at once goes there directly."""
    plan = [{**run, "sources": [run["folder"]]} for run in runs]
    for batch in arrived:
        plan.append({"level": 0, "first": batch, "last": batch, "sources": [f"{BATCH}{batch}"]})
        while len(plan) >= fan and len({run["level"] for run in plan[-fan:]}) == 1:
            merged = plan[-fan:]
            plan[-fan:] = [
                {
                    "level": merged[0]["level"] + 1,
                    "first": merged[0]["first"],
                    "last": merged[-1]["last"],
                    "sources": [source for run in merged for source in run["sources"]],
                }
            ]
    while plan and plan[-1]["level"] == 0:
        plan.pop()  # stays a folder of its own until enough others follow
    return plan


def compact(
    spark: SparkSession, path: str, n: int, chunks: int, done: int, fan: int = 8
) -> list[str]:
    """Merge what has come together of the micro-batches up to ``done``, all of which are written;
    return the folders read. One switch makes all merged runs live; a compaction that ends before it
    changes nothing. Folders of merged micro-batches go at the compaction after."""
    seen = live_number(spark, path)
    runs = _runs(spark, path, seen)
    last = _last(runs)
    found = set(_batches(spark, path))
    arrived = []
    # In order and without a gap: a missing micro-batch may still come.
    while last + len(arrived) + 1 in found and last + len(arrived) + 1 <= done:
        arrived.append(last + len(arrived) + 1)
    plan = merge_plan(runs, arrived, fan)
    read: list[str] = []
    state = []
    for run in plan:
        folder = run.get("folder")
        if folder is None:
            folder = new_folder()
            totals = recombine(_read(spark, path, run["sources"], n), n)
            write_table(with_chunk(totals, chunks), f"{path}/{folder}")
            read += run["sources"]
        state.append({k: run[k] for k in ("level", "first", "last")} | {"folder": folder})
    if read:
        switch(spark, path, seen, state, lambda runs: [run["folder"] for run in runs])
        for batch in found:
            if batch <= last:
                remove_folder(spark, f"{path}/{BATCH}{batch}")
    return read


def start_partial_counts(
    rows: DataFrame, n: int, path: str, checkpoint: str, chunks: int, fan: int = 8
) -> StreamingQuery:
    """Count whatever has arrived, micro-batch by micro-batch, merging ``fan`` runs at a time, then
    stop."""
    if fan < 2:
        raise ValueError("fan must be at least 2")

    def count(batch: DataFrame, batch_id: int) -> None:
        write_partial(batch, batch_id, n, path, chunks)
        compact(batch.sparkSession, path, n, chunks, batch_id, fan)

    return (
        rows.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders that hold every count once: merged runs, and micro-batches after the last of them."""
    runs = _runs(spark, path)
    later = [b for b in _batches(spark, path) if b > _last(runs)]
    return [run["folder"] for run in runs] + [f"{BATCH}{b}" for b in later]


def merge_partials(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Totals over all micro-batches."""
    return recombine(_read(spark, path, live_folders(spark, path), n), n)
