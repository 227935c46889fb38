"""N-gram counts over token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretoken.functions.ids import (
    PACKED_IDS,
    chunk_of,
    id_columns,
    packed_key,
    packed_key_of_any,
    unpacked_key,
    unpacked_key_of_any,
    whole_part,
)


def ngrams(rows: DataFrame, n: int, keep: list[str] | None = None, ids: str = "tokens") -> DataFrame:
    """Every run of ``n`` neighbouring ids of each row as ``id0..``; none crosses a row.

    No shuffle: places are generated and their ids read from the row's array in one code span.
    """
    keep = keep or []
    places = F.explode(F.sequence(F.lit(0), F.size(ids) - n)).alias("_place")
    return (
        rows.where(F.size(ids) >= n)
        .select(*keep, F.col(ids).alias("_ids"), places)
        .select(*keep, *[F.get("_ids", F.col("_place") + k).alias(f"id{k}") for k in range(n)])
    )


def _grouped(grams: DataFrame, n: int, keep: list[str], total: Column) -> DataFrame:
    """Totals per n-gram. Ids are packed into BIGINTs, four in each. Those of up to four must fit
    16 bits; a longer n-gram with one that does not is told by its ids themselves."""
    pack, unpack = (
        (packed_key, unpacked_key) if n <= PACKED_IDS else (packed_key_of_any, unpacked_key_of_any)
    )
    others = [c for c in grams.columns if c not in id_columns(n)]
    packed = grams.select(*others, *pack(id_columns(n)))
    key = [c for c in packed.columns if c not in others]
    return (
        packed.groupBy(*keep, *key)
        .agg(total.alias("count"))
        .select(*keep, *unpack(n), "count")
    )


def ngram_counts(
    rows: DataFrame,
    n: int,
    keep: list[str] | None = None,
    ids: str = "tokens",
    wanted: Column | None = None,
) -> DataFrame:
    """``(id0.., count)``. Counted before and after the shuffle, so frequent n-grams stay cheap.
    Only n-grams for which ``wanted`` holds are counted at all."""
    keep = keep or []
    grams = ngrams(rows, n, keep, ids)
    if wanted is not None:
        grams = grams.where(wanted)
    return _grouped(grams, n, keep, F.count("*"))


def with_chunk(counts: DataFrame, chunks: int) -> DataFrame:
    """Add the layout key ``id0_chunk``."""
    return counts.withColumn("id0_chunk", chunk_of(F.col("id0"), chunks))


def ngram_partials(rows: DataFrame, n: int, batch_size: int, chunks: int) -> DataFrame:
    """Counts per batch of rows, with their chunk key. Rows that bring their ``batch`` keep it: where all
    of a batch are in one task, none of its counts moves."""
    batched = rows if "batch" in rows.columns else rows.withColumn("batch", whole_part("sample", batch_size))
    return with_chunk(ngram_counts(batched, n, ["batch"]), chunks)


def recombine(partials: DataFrame, n: int) -> DataFrame:
    """Totals from partial counts."""
    return _grouped(partials.select(*id_columns(n), "count"), n, [], F.sum("count"))


def chunk_sizes(counts: DataFrame, chunks: int) -> DataFrame:
    """N-grams and occurrences per chunk."""
    return (
        with_chunk(counts, chunks)
        .groupBy("id0_chunk")
        .agg(F.count("*").alias("n_ngrams"), F.sum("count").alias("n_occurrences"))
    )
