"""Concatenate encoded documents and cut them into rows of equal length."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretoken.functions.ids import whole_part
from foretoken.operators.running_total import running_total
from foretoken.session import shared_folder

# Token ids that one block of neighbouring documents holds, and the most blocks there may be:
# beyond that, blocks grow with the corpus.
BLOCK_IDS = 1 << 22
MOST_BLOCKS = 1 << 20
# Bytes of block tables that one task of the no-wrap pack reads.
TABLE_BYTES = 64 << 20


def _join_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, at, piece)`` to ``(*keys, at, tokens)``; at most one piece per token."""
    return (
        pieces.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
        .select(*keys, F.get("pieces.at", F.lit(0)).alias("at"), F.flatten("pieces.piece").alias("tokens"))
    )


def block_edges(lengths: DataFrame, block_ids: int | None = None) -> pd.DataFrame:
    """``(shard, block, low, start)``: the first document of each block and the ids before it.

    A shard's documents are cut where their running total of ids passes a multiple of ``block_ids``,
    whatever the number of shards or the spread of ``doc_id``; only lengths are shuffled. The driver
    gets one row for each block: ``MOST_BLOCKS`` and one for each shard at most.
    """
    given = lengths.where("n > 0").select("shard", "doc_id", F.col("n").cast("bigint").alias("n"))
    if block_ids is None:
        # One number.
        total = given.agg(F.sum("n")).first()[0] or 0
        block_ids = max(BLOCK_IDS, -(-total // MOST_BLOCKS))
    placed = running_total(given, "shard", "doc_id", "n", "before")
    edges = placed.groupBy("shard", whole_part("before", block_ids).alias("block")).agg(
        F.min("doc_id").alias("low"), F.min("before").alias("start")
    )
    found = pd.DataFrame(
        [tuple(r) for r in edges.collect()], columns=["shard", "block", "low", "start"]
    )
    return found.astype(np.int64).sort_values(["shard", "block"], ignore_index=True)


def _blocked(encoded: DataFrame, edges: pd.DataFrame) -> DataFrame:
    """Documents with ids, their block as ``(start, first, last)``: where it starts in its shard, and
    whether no block of the shard comes before or after it. Only two numbers a document go to Python;
    its ids stay where they are."""
    # Edges in the order of (shard, low) are found by the shard's own stretch of them.
    shared = encoded.sparkSession.sparkContext.broadcast(
        tuple(edges[c].to_numpy() for c in ("shard", "low", "start"))
    )

    @F.pandas_udf("start bigint, first boolean, last boolean")
    def block_of(shard: pd.Series, doc_id: pd.Series) -> pd.DataFrame:
        shards, low, start = shared.value
        own, inverse = np.unique(shard.to_numpy(), return_inverse=True)
        begin, end = np.searchsorted(shards, own), np.searchsorted(shards, own, "right")
        at, docs = np.empty(len(shard), np.int64), doc_id.to_numpy()
        for k in range(len(own)):
            mine = inverse == k
            at[mine] = begin[k] + np.searchsorted(low[begin[k] : end[k]], docs[mine], "right") - 1
        return pd.DataFrame(
            {"start": start[at], "first": at == begin[inverse], "last": at == end[inverse] - 1}
        )

    return (
        encoded.where("n > 0")
        .select("shard", "doc_id", "ids", F.col("n").cast("bigint").alias("n"))
        .withColumn("block", block_of("shard", "doc_id"))
        .select("shard", "doc_id", "ids", "n", "block.*")
    )


def wrapped_rows(
    encoded: DataFrame,
    row_length: int,
    carry: DataFrame | None = None,
    block_ids: int | None = None,
) -> DataFrame:
    """All rows ``(shard, sample, tokens)``, with the unfinished last one of each shard.

    ``carry`` is ``(shard, total, ids)``: the tokens placed before these documents and the ids of
    the row they left unfinished.

    Ids are shuffled once, to blocks of neighbouring documents of about the same number of ids.
    Inside a block the places of its documents are a running total from the block's own start, which
    comes from the lengths alone, and its rows are put together where they are. Only the row that a
    block shares with the next is shuffled once more.
    """
    inside, shared = block_rows(encoded, row_length, carry, block_ids)
    if carry is not None:
        left_over = carry.where(F.size("ids") > 0).select(
            "shard",
            whole_part("total", row_length).alias("sample"),
            F.lit(0).alias("at"),
            F.col("ids").alias("piece"),
        )
        shared = shared.unionByName(left_over)
    return inside.unionByName(_join_pieces(shared, ["shard", "sample"]).drop("at"))


def block_rows(
    encoded: DataFrame, row_length: int, carry: DataFrame | None = None, block_ids: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows that lie inside a block, ``(shard, sample, tokens)``, and the pieces of all others,
    ``(shard, sample, at, piece)``."""
    placed = _blocked(encoded, block_edges(encoded.select("shard", "doc_id", "n"), block_ids))
    before = (
        Window.partitionBy("shard", "start")
        .orderBy("doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = placed.repartition("shard", "start").withColumn(
        "place", F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    if carry is not None:
        # One row for each shard; the ids stay behind.
        total = carry.select("shard", F.col("total").alias("_total"))
        placed = placed.join(F.broadcast(total), "shard", "left").withColumn(
            "place", F.col("place") + F.coalesce("_total", F.lit(0))
        )
    # A document is cut into one piece per row it touches, not into single tokens.
    touched = F.sequence(whole_part("place", row_length), whole_part("(place + n - 1)", row_length))
    begin = F.col("sample") * row_length
    cut = F.greatest(begin - F.col("place"), F.lit(0))
    stop = F.least(begin + row_length - F.col("place"), F.col("n"))
    pieces = placed.select(
        "shard", "start", "last", "ids", "n", "place", F.explode(touched).alias("sample")
    ).select(
        "shard",
        "start",
        "last",
        "sample",
        F.greatest(F.col("place") - begin, F.lit(0)).cast("int").alias("at"),
        F.slice("ids", (cut + 1).cast("int"), (stop - cut).cast("int")).alias("piece"),
    )
    in_block = _join_pieces(pieces, ["shard", "start", "last", "sample"])
    # The last row of a shard is unfinished, but all of it is here.
    inside = (F.size("tokens") == row_length) | (F.col("last") & (F.col("at") == 0))
    return (
        in_block.where(inside).select("shard", "sample", "tokens"),
        in_block.where(~inside).select("shard", "sample", "at", F.col("tokens").alias("piece")),
    )


def pack_wrap(encoded: DataFrame, row_length: int, block_ids: int | None = None) -> DataFrame:
    """Documents run on from row to row within a shard; its last ``< row_length`` ids are dropped."""
    rows = wrapped_rows(encoded, row_length, block_ids=block_ids)
    return rows.where(F.size("tokens") == row_length)


def pack_nowrap(
    encoded: DataFrame,
    row_length: int,
    block_ids: int | None = None,
    group_blocks: int | None = None,
) -> DataFrame:
    """Like :func:`pack_wrap`, but what is left of a document once its row is full is discarded.

    Ids are shuffled once, to their blocks, where documents are placed and rows put together; the
    fill and row at which a block starts come from the lengths alone. Only the row that a block
    shares with the next is shuffled once more.
    """
    edges = block_edges(encoded.select("shard", "doc_id", "n"), block_ids)
    blocked = _blocked(encoded, edges)
    starts = _block_starts(blocked.select("shard", "start", "doc_id", "n"), row_length, group_blocks)
    schema = "shard int, sample bigint, at int, last boolean, tokens array<int>"

    def cut(block: pa.Table) -> pa.Table:
        return _cut_rows(block, row_length)

    pieces = blocked.join(starts, ["shard", "start"]).groupBy("shard", "start").applyInArrow(cut, schema)
    inside = (F.size("tokens") == row_length) | (F.col("last") & (F.col("at") == 0))
    shared = pieces.where(~inside).select("shard", "sample", "at", F.col("tokens").alias("piece"))
    return (
        pieces.where(inside)
        .select("shard", "sample", "tokens")
        .unionByName(_join_pieces(shared, ["shard", "sample"]).drop("at"))
        .where(F.size("tokens") == row_length)
    )


def _block_starts(blocked: DataFrame, row_length: int, group_blocks: int | None = None) -> DataFrame:
    """``(shard, start, sample0, fill0)``: the row, and how full it is, where each block starts.

    How full the row is after a document depends on all documents before it. To keep a shard off a
    single task, each block of documents is first reduced to a table "fill before -> fill after,
    rows finished" over the ``row_length`` possible fills. Tables chain, so one pass over the block
    tables gives the fill at the start of every block. Groups hold as many blocks as have
    ``TABLE_BYTES`` of tables. Block tables are written once and read by both passes.
    """
    if group_blocks is None:
        group_blocks = max(2, TABLE_BYTES // (12 * row_length))
    table = "fills array<int>, finished array<bigint>"

    def summarise_documents(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("doc_id")
        fills, finished = _fill_table(block["n"].to_numpy(), row_length)
        return _one_row(block, ["shard", "start"], fills, finished)

    def summarise_blocks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        fills = np.arange(row_length)
        finished = np.zeros(row_length, dtype=np.int64)
        for after, rows in zip(group["fills"], group["finished"]):
            finished += np.asarray(rows)[fills]
            fills = np.asarray(after)[fills]
        return _one_row(group, ["shard", "block_group"], fills, finished)

    summaries = blocked.groupBy("shard", "start").applyInPandas(
        summarise_documents, f"shard int, start bigint, {table}"
    )
    spark = blocked.sparkSession
    path = shared_folder(spark)
    summaries.write.option("compression", "zstd").parquet(path)
    # A shard's blocks are numbered by their starts alone, without their tables.
    stored = spark.read.schema(summaries.schema).parquet(path)
    numbered = running_total(
        stored.select("shard", "start", F.lit(1).cast("bigint").alias("one")), "shard", "start", "one", "nth"
    ).select("shard", "start", whole_part("nth", group_blocks).alias("block_group"))
    blocks = stored.join(numbered, ["shard", "start"])
    groups = blocks.groupBy("shard", "block_group").applyInPandas(
        summarise_blocks, f"shard int, block_group bigint, {table}"
    )
    group_starts = (
        groups.groupBy("shard")
        .applyInPandas(
            lambda rows: _chain(rows, "block_group"),
            "shard int, block_group bigint, sample bigint, fill int",
        )
        .withColumnsRenamed({"sample": "sample0", "fill": "fill0"})
    )
    return (
        blocks.join(group_starts, ["shard", "block_group"])
        .groupBy("shard", "block_group")
        .applyInPandas(
            lambda rows: _chain(rows, "start"),
            "shard int, start bigint, sample bigint, fill int",
        )
        .withColumnsRenamed({"sample": "sample0", "fill": "fill0"})
    )


def _one_row(group: pd.DataFrame, keys: list[str], fills, finished) -> pd.DataFrame:
    row = {key: [group[key].iloc[0]] for key in keys}
    return pd.DataFrame({**row, "fills": [fills.astype(np.int32)], "finished": [finished]})


def _fill_table(lengths: np.ndarray, row_length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fill before these documents: the fill after them and the rows they finish."""
    origin = np.arange(row_length)
    finished = np.zeros(row_length, dtype=np.int64)
    fill = origin.copy()
    rows = np.zeros(row_length, dtype=np.int64)
    for i, n in enumerate(lengths):
        fill = fill + n
        full = fill >= row_length
        rows += full
        fill[full] = 0
        if i % 64 == 63:
            # Different fills soon meet in the same one; go on with the distinct ones only.
            finished += rows[origin]
            fill, where = np.unique(fill, return_inverse=True)
            origin = where[origin]
            rows = np.zeros(len(fill), dtype=np.int64)
    return fill[origin], finished + rows[origin]


def _chain(rows: pd.DataFrame, key: str) -> pd.DataFrame:
    """The row number and fill at the start of each part, from the tables of the parts."""
    rows = rows.sort_values(key)
    sample, fill = 0, 0
    if "sample0" in rows:
        sample, fill = int(rows["sample0"].iloc[0]), int(rows["fill0"].iloc[0])
    samples, fills = [], []
    for after, finished in zip(rows["fills"], rows["finished"]):
        samples.append(sample)
        fills.append(fill)
        sample, fill = sample + int(finished[fill]), int(after[fill])
    return pd.DataFrame(
        {"shard": rows["shard"], key: rows[key], "sample": samples, "fill": fills}
    )


def _cut_rows(block: pa.Table, row_length: int) -> pa.Table:
    """The rows of one block's documents, given the row and fill at its start: a piece for each."""
    block = block.sort_by("doc_id").combine_chunks()
    sample, fill = block.column("sample0")[0].as_py(), block.column("fill0")[0].as_py()
    samples, ats, kept = [], [], []
    room = []
    for n in block.column("n").to_pylist():
        if not room or fill == 0:
            samples.append(sample)
            ats.append(fill)
            room.append(0)
        used = min(n, row_length - fill)
        kept.append(used)
        room[-1] += used
        fill += n
        if fill >= row_length:
            sample, fill = sample + 1, 0
    ids = block.column("ids").combine_chunks()
    offsets = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.to_numpy(zero_copy_only=False)
    kept = np.array(kept, np.int64)
    # Each document gives its first ``kept`` ids.
    starts = np.repeat(offsets[:-1] - (np.cumsum(kept) - kept), kept)
    ends = np.concatenate([[0], np.cumsum(room)]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[starts + np.arange(len(starts))], pa.int32()))
    shard, last = block.column("shard")[0].as_py(), block.column("last")[0].as_py()
    return pa.table(
        {
            "shard": pa.array([shard] * len(samples), pa.int32()),
            "sample": pa.array(samples, pa.int64()),
            "at": pa.array(ats, pa.int32()),
            "last": pa.array([last] * len(samples), pa.bool_()),
            "tokens": tokens,
        }
    )
