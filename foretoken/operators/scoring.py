"""Probability of a catalogued next token under other distributions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foretoken.functions.ids import id_columns
from foretoken.functions.membership import possible_member
from foretoken.operators.ngrams import ngram_counts
from foretoken.operators.prefixes import width_of


def score_by_slice(
    top: DataFrame,
    encoded: DataFrame,
    slice_column: str,
    slices: list[str],
) -> DataFrame:
    """Add ``p_<slice>``: the share of the prefix's continuations, in the documents of that slice,
    that are the catalogued token; 0 where the slice never continues the prefix."""
    n = width_of(top)
    prefix, last = id_columns(n - 1), f"id{n - 1}"
    wanted = top.select(*prefix, F.col(last).alias("wanted"))
    wanted_slice = encoded.where(F.col(slice_column).isin(slices))
    # Count first: afterwards a prefix has at most one row per token and slice. N-grams of other
    # prefixes are told, but for a few in a hundred, before they are counted and shuffled; the join
    # drops the rest. Spark broadcasts the prefixes by their size on storage.
    likely = possible_member(wanted, prefix)
    hits = ngram_counts(wanted_slice, n, [slice_column], "ids", likely).join(wanted, prefix)
    weight = F.col("count")
    share = F.sum(F.when(F.col(last) == F.col("wanted"), weight).otherwise(0)) / F.sum(weight)
    scores = hits.groupBy(*prefix).pivot(slice_column, slices).agg(share)
    named = scores.withColumnsRenamed({s: f"p_{s}" for s in slices})
    return top.join(named, prefix, "left").select(
        *top.columns, *[F.coalesce(f"p_{s}", F.lit(0.0)).alias(f"p_{s}") for s in slices]
    )


def score_by_model(
    top: DataFrame,
    models: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]],
    batch_size: int = 512,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add ``p_<model>``: softmax probability of the last id given the ids before it.

    Each value of ``models`` is called once per task and returns a function from a matrix of prefix
    ids to a matrix of logits over the vocabulary. ``profile`` names what a model's task needs, such
    as all cores or an accelerator of an executor, so that each executor holds one model; other
    stages keep the session's resources.
    """
    n = width_of(top)
    prefix, last = id_columns(n - 1), f"id{n - 1}"
    out = spread_for_model(top, prefix)
    for name, make_predictor in models.items():
        schema = StructType([*out.schema.fields, StructField(f"p_{name}", DoubleType())])

        def score(
            frames: Iterator[pd.DataFrame], make=make_predictor, column=f"p_{name}"
        ) -> Iterator[pd.DataFrame]:
            predict = make()
            for frame in frames:
                p = np.empty(len(frame))
                for i in range(0, len(frame), batch_size):
                    part = frame.iloc[i : i + batch_size]
                    log_p = log_softmax(predict(part[prefix].to_numpy(np.int32)))
                    p[i : i + batch_size] = np.exp(
                        log_p[np.arange(len(part)), part[last].to_numpy()]
                    )
                yield frame.assign(**{column: p})

        out = out.mapInPandas(score, schema, profile=profile)
    return out


def spread_for_model(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key over the session's shuffle partitions, which adaptive execution must not merge: a
    model's time per row calls for far smaller tasks than their bytes."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *key)


def log_softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.asarray(logits, dtype=np.float64)
    shifted = shifted - shifted.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))
