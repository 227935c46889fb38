"""The most common next token of every prefix, and the tables published from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretoken.functions.ids import count_part, count_then_smallest_id, id_columns, id_part


def width_of(table: DataFrame) -> int:
    """The number of id columns ``id0..`` of a table."""
    return 1 + max(int(c[2:]) for c in table.columns if c.startswith("id") and c[2:].isdigit())


def next_token_prefixes(counts: DataFrame) -> DataFrame:
    """``(id0.., sum_count, max_count, frac_max)``: the last id is the commonest one, ties to the
    smallest id. N-gram counts are unique rows, and a prefix is summed up before the shuffle."""
    n = width_of(counts)
    prefix, last = id_columns(n - 1), f"id{n - 1}"
    return (
        counts.groupBy(*prefix)
        .agg(
            F.max(count_then_smallest_id(F.col("count"), F.col(last))).alias("best"),
            F.sum("count").alias("sum_count"),
        )
        .select(
            *prefix,
            id_part(F.col("best")).alias(last),
            "sum_count",
            count_part(F.col("best")).alias("max_count"),
            (count_part(F.col("best")) / F.col("sum_count")).alias("frac_max"),
        )
    )


def predictive(
    prefixes: DataFrame, min_fraction: float, min_count: int | None = None
) -> DataFrame:
    """Prefixes that almost settle their next token; both limits are strict."""
    kept = prefixes.where(F.col("frac_max") > min_fraction)
    return kept if min_count is None else kept.where(F.col("sum_count") > min_count)


def add_tokens(table: DataFrame, tokens: DataFrame) -> DataFrame:
    """Add ``token{i}`` for every ``id{i}`` and their concatenation ``seq``.

    An id without a token is an error. ``tokens``, at most 65,536 rows, goes to every task whatever
    the session's threshold: by a shuffle, ``table`` would move once for each id.
    """
    n = width_of(table)
    out = table
    for k in range(n):
        lookup = tokens.select(F.col("id").alias(f"id{k}"), F.col("token").alias(f"token{k}"))
        out = out.join(F.broadcast(lookup), f"id{k}", "left")
    named = [_required(F.col(f"token{k}"), F.col(f"id{k}")).alias(f"token{k}") for k in range(n)]
    return out.select(*table.columns, *named).withColumn(
        "seq", F.concat(*[f"token{k}" for k in range(n)])
    )


def _required(token: Column, token_id: Column) -> Column:
    missing = F.raise_error(F.concat(F.lit("no token for id "), token_id.cast("string")))
    return F.when(token.isNull(), missing).otherwise(token)


def lookup_misses(table: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per id column: distinct ids used and how many of them have no token."""
    parts = [
        table.select(F.col(f"id{k}").alias("id")).distinct().withColumn("position", F.lit(k))
        for k in range(width_of(table))
    ]
    used = parts[0]
    for part in parts[1:]:
        used = used.unionByName(part)
    return (
        used.join(F.broadcast(tokens), "id", "left")
        .groupBy("position")
        .agg(
            F.count("*").alias("n_ids"),
            F.count_if(F.col("token").isNull()).alias("n_missing"),
        )
    )


def by_fraction(prefixes: DataFrame) -> DataFrame:
    return prefixes.orderBy(F.desc("frac_max"), *id_columns(width_of(prefixes)))


def by_count(prefixes: DataFrame) -> DataFrame:
    return prefixes.orderBy(F.desc("sum_count"), *id_columns(width_of(prefixes)))


def rank_in_chunk(prefixes: DataFrame) -> DataFrame:
    """The position of each prefix in its chunk, most predictive first, ties by id.

    A chunk may hold a third of all prefixes, most of them with the same fraction. Ranks are
    therefore added up over levels (range of fractions, fraction, then one id after the other), each
    a window over a few counts. Prefixes are counted once, at the finest level, and the coarser ones
    are made from that; the last window holds prefixes that differ in their last id only: at most
    one vocabulary.
    """
    n = width_of(prefixes)
    ids = id_columns(n - 1)  # of the prefix; the last column is its most common next token
    binned = prefixes.withColumn("bin", F.floor(F.col("frac_max") * FRACTION_BINS))
    levels = [("bin", F.desc), ("frac_max", F.desc), *((c, F.asc) for c in ids[:-1])]
    keys = [key for key, _ in levels]
    finest = binned.groupBy("id0_chunk", *keys).agg(F.count("*").alias("size"))
    starts = None
    for depth, (key, order) in enumerate(levels):
        parent = ["id0_chunk", *keys[:depth]]
        above = F.sum("size").over(
            Window.partitionBy(*parent)
            .orderBy(order(key))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        sizes = finest.groupBy(*parent, key).agg(F.sum("size").alias("size"))
        level = sizes.withColumn("here", F.coalesce(above, F.lit(0)))
        if starts is None:
            starts = level.select(*parent, key, F.col("here").alias("above"))
        else:
            starts = level.join(starts, parent).select(
                *parent, key, (F.col("above") + F.col("here")).alias("above")
            )
    group = ["id0_chunk", *keys]
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(ids[-1]))
    return (
        binned.withColumn("inside", inside)
        .join(starts, group)
        .select(*prefixes.columns, (F.col("above") + F.col("inside")).alias("rank"))
    )


FRACTION_BINS = 1024
