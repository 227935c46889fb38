"""Column expressions over token id columns ``id0``, ``id1``, ..."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretoken.settings import ID_SPAN

# Ids that fit one BIGINT.
PACKED_IDS = 4


def id_columns(n: int, start: int = 0) -> list[str]:
    return [f"id{k}" for k in range(start, start + n)]


def chunk_of(first_id: Column, chunks: int) -> Column:
    return F.pmod(first_id, F.lit(chunks)).cast("int")


def packed_ids(columns: list[str]) -> Column:
    """Up to four 16-bit ids as one BIGINT: a single group key of a third of the shuffled bytes.

    An id that does not fit is an error.
    """
    shown = F.concat_ws(", ", *[F.col(c).cast("string") for c in columns])
    outside = F.raise_error(F.concat(F.lit("ids that do not fit 16 bits: "), shown))
    return F.when(_fit(columns), _packed(columns)).otherwise(outside)


def _packed(columns: list[str]) -> Column:
    packed = F.col(columns[0]).cast("bigint")
    for column in columns[1:]:
        packed = F.shiftleft(packed, 16).bitwiseOR(F.col(column).cast("bigint"))
    return packed


def _fit(columns: list[str]) -> Column:
    bits = F.col(columns[0])
    for column in columns[1:]:
        bits = bits.bitwiseOR(F.col(column))
    return F.shiftrightunsigned(bits, 16) == 0


def unpacked_ids(packed: str | Column, n: int, start: int = 0) -> list[Column]:
    return [
        F.shiftright(packed, 16 * (n - 1 - k))
        .bitwiseAND(F.lit(ID_SPAN - 1))
        .cast("int")
        .alias(f"id{start + k}")
        for k in range(n)
    ]


def packed_key(columns: list[str], prefix: str = "ngram") -> list[Column]:
    """Any number of ids as BIGINTs ``prefix0..`` of up to four ids each."""
    return [
        packed_ids(columns[k : k + PACKED_IDS]).alias(f"{prefix}{k // PACKED_IDS}")
        for k in range(0, len(columns), PACKED_IDS)
    ]


def unpacked_key(n: int, prefix: str = "ngram") -> list[Column]:
    """The ids ``id0..`` of a key of :func:`packed_key`."""
    return [
        column
        for k in range(0, n, PACKED_IDS)
        for column in unpacked_ids(f"{prefix}{k // PACKED_IDS}", min(PACKED_IDS, n - k), k)
    ]


def packed_key_of_any(columns: list[str], prefix: str = "ngram") -> list[Column]:
    """:func:`packed_key` for more than four ids of any size. The last column is an array: of its
    BIGINT, or where an id does not fit of all ids, and then the other columns are null."""
    fit = F.coalesce(_fit(columns), F.lit(False))
    *others, last = [columns[k : k + PACKED_IDS] for k in range(0, len(columns), PACKED_IDS)]
    whole = F.array(*[F.col(c).cast("bigint") for c in columns])
    return [
        *[F.when(fit, _packed(part)).alias(f"{prefix}{k}") for k, part in enumerate(others)],
        F.when(fit, F.array(_packed(last))).otherwise(whole).alias(f"{prefix}{len(others)}"),
    ]


def unpacked_key_of_any(n: int, prefix: str = "ngram") -> list[Column]:
    """The ids ``id0..`` of a key of :func:`packed_key_of_any`."""
    start = (n - 1) // PACKED_IDS * PACKED_IDS
    last = F.col(f"{prefix}{start // PACKED_IDS}")
    fit = F.col(f"{prefix}0").isNotNull()
    packed = [*unpacked_key(start, prefix), *unpacked_ids(F.get(last, 0), n - start, start)]
    return [
        F.when(fit, column).otherwise(F.get(last, k).cast("int")).alias(f"id{k}")
        for k, column in enumerate(packed)
    ]


def whole_part(value: str, size: int) -> Column:
    """Which run of ``size`` neighbours the value falls in, by integer division."""
    return F.expr(f"{value} div {size}")


def count_then_smallest_id(count: Column, token_id: Column) -> Column:
    """One BIGINT that orders by count, then by smaller id.

    Its maximum is an arg-max with a fixed tie rule that stays a hash aggregate: Spark sorts its
    input for ``max_by`` over a struct. Holds for counts below 2**47.
    """
    return count * F.lit(ID_SPAN) + (F.lit(ID_SPAN - 1) - token_id)


def count_part(packed: Column) -> Column:
    return F.shiftright(packed, 16)


def id_part(packed: Column) -> Column:
    return (F.lit(ID_SPAN - 1) - packed.bitwiseAND(F.lit(ID_SPAN - 1))).cast("int")
