"""Token counts and the table of token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretoken.functions.text import split_tokens
from foretoken.settings import FIRST_BYTE_ID, FIRST_TOKEN_ID, RESERVED_TOKENS


def token_counts(documents: DataFrame) -> DataFrame:
    """``(token, count)`` over all texts; map-side counting absorbs frequent tokens."""
    return (
        documents.select(F.explode(split_tokens(F.col("text"))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("count"))
    )


# Longer tokens are spelled byte by byte, so that a table has at most 4 MB of text.
TOKEN_BYTES = 64
# Groups in which the most frequent tokens are found before they meet in one task.
GROUPS = (4096, 64)


def byte_token(byte: int) -> str:
    return f"<0x{byte:02X}>"


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """``(id, token)``: two reserved ids, the 256 bytes, then the most frequent tokens, ties by token.

    Only tokens whose count has enough binary digits to matter are compared. As any number of them
    may have the count at the cut, they are cut to the size of the table in 4096 groups by hash,
    then in 64; so the task that numbers them sees at most 64 times the table.
    """
    keep = size - FIRST_TOKEN_ID
    short = counts.where(F.octet_length("token") <= TOKEN_BYTES)
    sized = short.withColumn("digits", F.length(F.bin("count")))
    per_digits = sized.groupBy("digits").agg(F.count("*").alias("n"))
    # At most 63 rows: the more frequent tokens that precede each class of counts.
    before = F.sum("n").over(
        Window.orderBy(F.desc("digits")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("n")
    cutoff = (
        per_digits.withColumn("before", before)
        .where(F.col("before") < keep)
        .agg(F.min("digits").alias("cutoff"))
    )
    order = [F.desc("count"), F.col("token")]
    first = sized.where(F.col("digits") >= cutoff.scalar())
    for groups in GROUPS:
        group = F.pmod(F.hash("token"), F.lit(groups))
        place = F.row_number().over(Window.partitionBy("group").orderBy(*order))
        first = (
            first.withColumn("group", group).withColumn("place", place)
            .where(F.col("place") <= keep).drop("group", "place")
        )
    number = F.row_number().over(Window.orderBy(*order)) + (FIRST_TOKEN_ID - 1)
    ranked = first.orderBy(*order).limit(keep).select(number.cast("int").alias("id"), "token")
    fixed = [*RESERVED_TOKENS.items(), *((FIRST_BYTE_ID + b, byte_token(b)) for b in range(256))]
    return counts.sparkSession.createDataFrame(fixed, "id int, token string").unionByName(ranked)
