"""Running totals over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A BIGINT order key is cut at these bits, so no window ever holds more than 2**22 rows.
BLOCK_BITS = (22, 44)


def running_total(
    rows: DataFrame,
    group: str,
    order: str,
    value: str,
    out: str,
    block_bits: tuple[int, ...] = BLOCK_BITS,
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group with a smaller ``order``.

    ``order`` is a BIGINT, unique in its group. Rows fall into blocks of neighbouring order values,
    blocks into larger blocks; totals are taken inside each level and added up. A group that holds
    most of the rows is therefore spread over as many tasks as it has blocks.
    """
    levels = [F.col(order), *[F.shiftright(F.col(order), bits) for bits in block_bits]]
    keyed = rows.select("*", *[key.alias(f"_block{i}") for i, key in enumerate(levels) if i])

    result = None
    for level in reversed(range(len(levels))):
        inside = [f"_block{level + 1}"] if level + 1 < len(levels) else []
        if level == 0:
            base, key = keyed, F.col(order)
        else:
            base = keyed.groupBy(group, f"_block{level}", *inside).agg(F.sum(value).alias(value))
            key = F.col(f"_block{level}")
        window = (
            Window.partitionBy(group, *inside)
            .orderBy(key)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        before = F.coalesce(F.sum(value).over(window), F.lit(0))
        if result is None:
            totals = base.withColumn("_before", before)
        else:
            totals = (
                base.withColumn("_inner", before)
                .join(result, [group, *inside])
                .withColumn("_before", F.col("_inner") + F.col("_before"))
            )
        if level:
            result = totals.select(group, f"_block{level}", "_before")
    return totals.select(*rows.columns, F.col("_before").cast("bigint").alias(out))
