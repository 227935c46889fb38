"""Places where one more leading token strongly changes what comes next.

A long context is a run of ``seq_len + 1`` ids, its short context the same run without the first.
Their next-token distributions come from n-gram counts, one row per distinct context, and are only
then brought back to the places in the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretoken.functions.ids import PACKED_IDS, id_columns, packed_key, unpacked_ids, whole_part
from foretoken.operators.encoding import decode_rows
from foretoken.operators.prefixes import add_tokens, width_of
from foretoken.operators.scoring import log_softmax, spread_for_model
from foretoken.settings import ID_SPAN

# Sample numbers of a shard that fit the key by which places are ordered.
SAMPLE_BITS = 32

METRICS = [
    "p_short",
    "p_long",
    "js",
    "p_delta_max",
    "logit_excite_max",
    "logit_inhibit_max",
    "short_max_id",
    "long_max_id",
]


def windows(samples: DataFrame, seq_len: int, context_ids: int | None = None) -> DataFrame:
    """``(shard, sample, start, id0..)``: every long context; ``start`` is where the short one
    begins. A row of L ids has ``L - seq_len`` of them.

    With ``context_ids``, also the ids around it, that many on either side or up to the ends of the
    row. They are cut out here, so that no later step moves a place's whole row.
    """
    around = []
    if context_ids is not None:
        begin = F.greatest(F.col("start") - context_ids, F.lit(0))
        end = F.least(F.col("start") + seq_len + context_ids, F.size("tokens"))
        around = [F.slice("tokens", begin + 1, end - begin).alias("context_ids")]
    starts = F.explode(F.sequence(F.lit(1), F.size("tokens") - seq_len)).alias("start")
    ids = [F.get("tokens", F.col("start") + (k - 1)).alias(f"id{k}") for k in range(seq_len + 1)]
    return (
        samples.where(F.size("tokens") > seq_len)
        .select("shard", "sample", "tokens", starts)
        .select("shard", "sample", "start", *ids, *around)
    )


def paired_windows(samples: DataFrame, seq_len: int) -> DataFrame:
    """The long and short context at every place, as arrays."""
    ids = id_columns(seq_len + 1)
    return windows(samples, seq_len).select(
        "shard",
        "sample",
        "start",
        F.array(*ids).alias("long_ids"),
        F.array(*ids[1:]).alias("short_ids"),
    )


def _short_distribution(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``said``: for a short n-gram, one whose ``first`` is null, ``(p_short, rank, n_short,
    top_id, top_p, after_id, after_p)`` of its next token; null for a long one. ``after_id`` is the token
    after it in rank, if any.

    A window holds the distinct next tokens of one context, never more than the vocabulary. Long contexts
    have windows of their own here, whose results are not used.
    """
    whole = Window.partitionBy(*key, "first")
    ranked = whole.orderBy(F.desc("count"), "next")
    said = F.struct(
        (F.col("count") / F.col("total")).alias("p_short"),
        F.col("place").alias("rank"),
        "n_short",
        "top_id",
        (F.col("top_count") / F.col("total")).alias("top_p"),
        "after_id",
        (F.col("after_count") / F.col("total")).alias("after_p"),
    )
    return (
        rows.withColumn("place", F.row_number().over(ranked))
        .withColumn("top_id", F.first("next").over(ranked))
        .withColumn("top_count", F.first("count").over(ranked))
        .withColumn("after_id", F.lead("next").over(ranked))
        .withColumn("after_count", F.lead("count").over(ranked))
        .withColumn("total", F.sum("count").over(whole))
        .withColumn("n_short", F.count("*").over(whole))
        .select(*rows.columns, F.when(F.col("first").isNull(), said).alias("said"))
    )


# Occurrences of a short context for each of the parts that its long contexts are dealt to, and the
# fewest that a short n-gram must have to be looked at for that: a context that is far over the first
# has such n-grams, as its next tokens fit 16 bits.
PART_PLACES = 1 << 20
FEWEST = PART_PLACES // ID_SPAN


def _parts_of(short: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, parts)`` of the short contexts that are too frequent for one task: at most one for
    every ``PART_PLACES`` places of the corpus."""
    return (
        short.where(F.col("count") >= FEWEST)
        .groupBy(*key)
        .agg(F.sum("count").alias("places"))
        .where(F.col("places") > PART_PLACES)
        .select(*key, whole_part("places", PART_PLACES).cast("int").alias("parts"))
    )


def _beside_short(short_counts: DataFrame, long_counts: DataFrame) -> tuple[DataFrame, list[str]]:
    """Long n-grams, ``(*key, first, next, count, ..)``, with what :func:`_short_distribution` says of
    the next token; and the columns ``key`` by which they are dealt.

    Short and long n-grams meet in one shuffle, by the short context: it holds all its next tokens
    and all its long contexts, so every window and sum stays where it is, and what is said of the short
    n-grams is never moved. The long contexts
    of a frequent short one are dealt to several parts, each with its few short n-grams.
    """
    n = width_of(long_counts)
    key = [f"short{k // PACKED_IDS}" for k in range(0, n - 2, PACKED_IDS)]
    # The short n-gram of (id0, id1, .., next) is (id1, .., next).
    context = packed_key(id_columns(n - 2), "short")
    short = short_counts.select(*context, F.col(f"id{n - 2}").alias("next"), "count")
    long = long_counts.where(F.col("id0").isNotNull()).select(
        *packed_key(id_columns(n - 2, 1), "short"),
        F.col("id0").alias("first"),
        F.col(f"id{n - 1}").alias("next"),
        "count",
    )
    parts = F.broadcast(_parts_of(short, key))
    dealt = long.join(parts, key, "left").select(
        *long.columns, F.coalesce(F.pmod(F.hash("first"), F.col("parts")), F.lit(0)).alias("part")
    )
    copied = short.join(parts, key, "left").select(
        *short.columns,
        F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"),
    )
    key = [*key, "part"]
    # A next token has one short n-gram here, and it comes first.
    same = (
        Window.partitionBy(*key, "next")
        .orderBy(F.col("said").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    met = dealt.unionByName(copied, allowMissingColumns=True).repartition(*key)
    told = (
        _short_distribution(met, key)
        .withColumn("said", F.first("said", ignorenulls=True).over(same))
        .where(F.col("first").isNotNull() & F.col("said").isNotNull())
    )
    return told.select(*key, "first", "next", "count", "said.*"), key


def _seen(
    short_counts: DataFrame, long_counts: DataFrame, backoff: float
) -> tuple[DataFrame, list[str]]:
    """:func:`_beside_short` with ``p_long`` and what else the long context says."""
    joined, key = _beside_short(short_counts, long_counts)
    whole = Window.partitionBy(*key, "first").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    seen = (
        joined.withColumn("weight", F.col("count") + F.lit(backoff) * F.col("p_short"))
        .withColumn(
            "seen_rank",
            F.row_number().over(Window.partitionBy(*key, "first").orderBy("rank")),
        )
        .withColumn("n_context", F.sum("count").over(whole))
        .withColumn("n_long", F.count("*").over(whole))
        .withColumn("best", F.col("weight") == F.max("weight").over(whole))
        .withColumn("p_long", F.col("weight") / (F.col("n_context") + F.lit(backoff)))
    )
    return seen, key


def _short_ids(n: int) -> list[Column]:
    """The ids ``id1..`` of the short context of a long n-gram of ``n`` ids."""
    width = n - 2
    return [
        column
        for k in range(0, width, PACKED_IDS)
        for column in unpacked_ids(f"short{k // PACKED_IDS}", min(PACKED_IDS, width - k), k + 1)
    ]


def next_token_distribution(
    short_counts: DataFrame, long_counts: DataFrame, backoff: float
) -> DataFrame:
    """``(id0.., p_short, p_long, n_context, ..)`` for every token seen after a long context.

    ``p_long = (count + backoff * p_short) / (n_context + backoff)``, so a token that only the short
    context knows keeps some probability.
    """
    n = width_of(long_counts)
    seen, _ = _seen(short_counts, long_counts, backoff)
    return seen.select(
        F.col("first").alias("id0"),
        *_short_ids(n),
        F.col("next").alias(f"id{n - 1}"),
        "p_short",
        "p_long",
        "n_context",
        "n_long",
        "n_short",
        "rank",
        "seen_rank",
        "best",
        "top_id",
        "top_p",
    )


def scan_metrics(
    short_counts: DataFrame, long_counts: DataFrame, backoff: float
) -> DataFrame:
    """One row per long context with :data:`METRICS`.

    Sums and maxima run over the tokens seen after the long context. For all others
    ``p_long = r * p_short`` with ``r = backoff / (n_context + backoff)``, so their part of the
    divergence follows from the short probability left over, and their extremes from the most
    probable token not seen: the first gap in the ranks of the seen ones, which is the token after
    the last one before the gap. The work is one row per n-gram rather than one per context and
    known token, and one shuffle.
    """
    n = width_of(long_counts)
    seen, key = _seen(short_counts, long_counts, backoff)
    seen = seen.withColumn("gain", F.ln("p_long") - F.ln("p_short"))
    # Only sums, counts and extremes of numbers, on rows the windows already brought together: a
    # hash aggregate without a shuffle.
    unbroken = F.col("rank") == F.col("seen_rank")
    # A rank of 16,384 or more does not fit an INT here.
    after = F.col("rank").cast("bigint") * (2 * ID_SPAN) + F.coalesce(F.col("after_id") + 1, F.lit(0))
    per_context = seen.groupBy(*key, "first").agg(
        (F.sum((F.col("p_long") - F.col("p_short")) * F.col("gain")) / 2).alias("js"),
        F.sum("p_short").alias("mass"),
        F.max("gain").alias("excite"),
        (-F.min("gain")).alias("inhibit"),
        F.max(F.abs(F.col("p_short") - F.col("p_long"))).alias("delta"),
        F.max("p_long").alias("p_seen"),
        F.min(F.when(F.col("best"), F.col("next"))).alias("seen_id"),
        # Of the seen tokens before the gap, the last has the largest rank and the least after it.
        F.max(F.when(unbroken, after)).alias("after"),
        F.min(F.when(unbroken, F.col("after_p"))).alias("after_p"),
        F.first("n_context").alias("n_context"),
        F.first("top_id").alias("short_max_id"),
        F.first("top_p").alias("p_short"),
    )
    after_id = F.col("after").bitwiseAND(F.lit(2 * ID_SPAN - 1)).cast("int")
    found = per_context.withColumn(
        "unseen_id",
        F.when(F.col("after").isNull(), F.col("short_max_id")).when(after_id > 0, after_id - 1),
    ).withColumn(
        "unseen_p",
        F.when(F.col("after").isNull(), F.col("p_short")).when(after_id > 0, F.col("after_p")),
    )
    rest = F.lit(backoff) / (F.col("n_context") + F.lit(backoff))
    has_unseen = F.col("unseen_id").isNotNull()
    unseen_long = F.lit(backoff) * F.col("unseen_p") / (F.col("n_context") + F.lit(backoff))
    unseen_first = has_unseen & (
        (unseen_long > F.col("p_seen"))
        | ((unseen_long == F.col("p_seen")) & (F.col("unseen_id") < F.col("seen_id")))
    )
    return found.select(
        F.col("first").alias("id0"),
        *_short_ids(n),
        "n_context",
        "p_short",
        F.when(unseen_first, unseen_long).otherwise(F.col("p_seen")).alias("p_long"),
        (
            F.col("js")
            + F.when(has_unseen, (1 - rest) * -F.ln(rest) / 2 * (1 - F.col("mass"))).otherwise(0.0)
        ).alias("js"),
        F.greatest("delta", (1 - rest) * F.col("unseen_p")).alias("p_delta_max"),
        F.col("excite").alias("logit_excite_max"),
        F.when(has_unseen, -F.ln(rest)).otherwise(F.col("inhibit")).alias("logit_inhibit_max"),
        "short_max_id",
        F.when(unseen_first, F.col("unseen_id")).otherwise(F.col("seen_id")).alias("long_max_id"),
    )


def scan_metrics_by_model(
    contexts: DataFrame,
    make_predictor: Callable[
        [], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    ],
    micro_batch: int = 512,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """:data:`METRICS` of distinct long contexts ``id0..`` under a model of the caller's.

    ``make_predictor`` is called once per task and returns a function from the short and long ids,
    one row per context, to their logits over the vocabulary. ``profile``: what a task of the model
    needs, as in :func:`foretoken.operators.scoring.score_by_model`.
    """
    ids = id_columns(width_of(contexts))
    key_types = ", ".join(f"{c} int" for c in ids)
    schema = (
        f"{key_types}, p_short double, p_long double, js double, p_delta_max double, "
        "logit_excite_max double, logit_inhibit_max double, short_max_id int, long_max_id int"
    )

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predictor()
        for frame in frames:
            for i in range(0, len(frame), micro_batch):
                part = frame.iloc[i : i + micro_batch].reset_index(drop=True)
                long_ids = part[ids].to_numpy(np.int32)
                logit_s, logit_l = predict(long_ids[:, 1:], long_ids)
                yield part.assign(**_model_metrics(logit_s, logit_l))

    return spread_for_model(contexts.select(*ids).distinct(), ids).mapInPandas(
        score, schema, profile=profile
    )


def _model_metrics(logit_s: np.ndarray, logit_l: np.ndarray) -> dict[str, np.ndarray]:
    log_s, log_l = log_softmax(logit_s), log_softmax(logit_l)
    p_s, p_l = np.exp(log_s), np.exp(log_l)
    moved = np.asarray(logit_l, np.float64) - np.asarray(logit_s, np.float64)
    return {
        "p_short": p_s.max(axis=1),
        "p_long": p_l.max(axis=1),
        "js": ((p_l - p_s) * (log_l - log_s)).sum(axis=1) / 2,
        "p_delta_max": np.abs(p_s - p_l).max(axis=1),
        "logit_excite_max": moved.max(axis=1),
        "logit_inhibit_max": (-moved).max(axis=1),
        "short_max_id": p_s.argmax(axis=1).astype(np.int32),
        "long_max_id": p_l.argmax(axis=1).astype(np.int32),
    }


def scan_hits(metrics: DataFrame, min_p: float = 0.5, min_js: float = 0.5) -> DataFrame:
    """Contexts whose long prediction is confident and differs from the short one."""
    return metrics.where((F.col("p_long") > min_p) & (F.col("js") > min_js))


def scan_examples(
    samples: DataFrame, hits: DataFrame, tokens: DataFrame, batch_size: int, context_ids: int = 5
) -> DataFrame:
    """Every place of every hit, with its text, surroundings and metrics.

    Rows are read once, and a place brings the few ids around it to the join with the hits, not its
    row. Spark broadcasts the hits by their size on storage; a larger list is joined by a shuffle of
    places, in which a context with a third of all places is split as a skewed partition.
    """
    ids = _context_columns(hits)
    found = windows(samples, len(ids) - 1, context_ids).join(hits, ids)
    return _describe(found, tokens, batch_size)


def scan_filter(
    samples: DataFrame, hits: DataFrame, tokens: DataFrame, batch_size: int, context_ids: int = 5
) -> DataFrame:
    """The first place of every hit text, in the order of shard, sample and start.

    The first place of each context, with the ids around it, is a minimum that is taken before any
    row is moved and before the join with the hits: rows are read once, and one place of each context
    and task is shuffled. Contexts that share a text are few and compared afterwards.
    """
    ids = _context_columns(hits)
    at = windows(samples, len(ids) - 1, context_ids).select(
        *ids, F.struct(_place().alias("place"), "context_ids").alias("at")
    )
    firsts = at.groupBy(*ids).agg(F.min("at").alias("at"))
    text = _with_text(firsts.join(hits, ids), tokens, ids)
    first_of_text = Window.partitionBy("text").orderBy("at.place")
    place = F.col("at.place")
    kept = (
        text.withColumn("nth", F.row_number().over(first_of_text))
        .where(F.col("nth") == 1)
        .withColumn("shard", F.shiftright(place, 48).cast("int"))
        .withColumn("sample", F.shiftright(place, 16).bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1)))
        .withColumn("start", place.bitwiseAND(F.lit((1 << 16) - 1)).cast("int"))
        .withColumn("context_ids", F.col("at.context_ids"))
        .drop("nth", "at", "text")
    )
    return _describe(kept, tokens, batch_size)


def _place() -> Column:
    """One BIGINT in the order of shard, sample and start; a sample too large for it is an error."""
    checked = F.when(F.col("sample") < 1 << SAMPLE_BITS, F.col("sample")).otherwise(
        F.raise_error(F.concat(F.lit("no place for sample "), F.col("sample").cast("string")))
    )
    return F.shiftleft(F.col("shard").cast("bigint"), 48) + F.shiftleft(checked, 16) + F.col("start")


def scan_top(found: DataFrame) -> DataFrame:
    """Examples by falling ``p_long``."""
    return found.orderBy(F.desc("p_long"), "text", "shard", "batch", "sample", "start")


def _context_columns(hits: DataFrame) -> list[str]:
    return id_columns(width_of(hits))


def _bracketed(first: Column, others: list[str]) -> Column:
    return F.concat(F.lit("["), first, F.lit("]"), *others)


def _with_text(rows: DataFrame, tokens: DataFrame, ids: list[str]) -> DataFrame:
    named = add_tokens(rows, tokens)
    names = [f"token{k}" for k in range(len(ids))]
    return named.withColumn("text", _bracketed(F.col(names[0]), names[1:])).drop("seq", *names)


def _describe(placed: DataFrame, tokens: DataFrame, batch_size: int) -> DataFrame:
    """Add texts and batch to places ``(shard, sample, start, id0.., context_ids, metrics)``."""
    ids = [c for c in id_columns(64) if c in placed.columns]
    text = _with_text(placed, tokens, ids)
    for side in ("short", "long"):
        lookup = tokens.select(
            F.col("id").alias(f"{side}_max_id"), F.col("token").alias(f"token_{side}")
        )
        text = text.join(F.broadcast(lookup), f"{side}_max_id", "left")
    return decode_rows(text, tokens, "context_ids", "context").select(
        "text",
        "token_short",
        "token_long",
        "p_short",
        "p_long",
        "js",
        F.array(*ids).alias("long_ids"),
        "short_max_id",
        "long_max_id",
        "context",
        "context_ids",
        "p_delta_max",
        "logit_excite_max",
        "logit_inhibit_max",
        "shard",
        whole_part("sample", batch_size).alias("batch"),
        F.pmod(F.col("sample"), F.lit(batch_size)).alias("sample"),
        "start",
    )
