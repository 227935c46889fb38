"""Column expressions between text, tokens and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from foretoken.settings import TEXT_BOUNDARY_ID

# Fixed value: a word or a number with its leading space, a run of other signs, or a run of blanks.
TOKEN_PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^ \t\n\r\f\x0B\p{L}\p{N}]+|[ \t\n\r\f\x0B]+"


def split_tokens(text: Column) -> Column:
    """Every token of the text, in order; joined together they give the text back."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def with_boundaries(
    ids: Column,
    begin: Sequence[int] = (TEXT_BOUNDARY_ID,),
    end: Sequence[int] = (TEXT_BOUNDARY_ID,),
) -> Column:
    """The ids of one document between its begin and end marks."""
    marks = [F.array(*[F.lit(i) for i in mark]).cast("array<int>") for mark in (begin, end)]
    return F.concat(marks[0], ids, marks[1])
