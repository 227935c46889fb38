"""Format conversations by a template that is only ever called, never looked into.

Successive prefixes of a conversation are rendered and consecutive outputs compared: what a turn
adds is its span, and a template whose output for more turns does not begin with its output for
fewer has rewritten history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch, partitions
from foretoken.operators.running_total import running_total

# Turns that one piece of a long conversation holds; every prefix inside a piece is rendered.
PIECE = 64
# Where null turns stand: before all others.
NO_TURN = -(1 << 62)
LOSS_ROLE = "assistant"

# Control strings of the template; a backslash keeps the same characters apart inside texts.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Make control strings in a text harmless; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The template of the registered query: every turn between control strings."""
    return "".join(f"{OPEN}{escape_role(r)}\n{escape(t)}{CLOSE}\n" for r, t in turns)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Read roles and texts back from what ``marked_turns`` made."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: rest.rindex(CLOSE)])))
    return turns


class RewritesHistory(ValueError):
    """More turns changed what the template had made of the turns before."""


# Two texts that share neither a first nor a last character.
PROBES = ("a", "z\nz")


def turn_spans(
    turns: list[tuple[str, str]],
    render: Callable[[list[tuple[str, str]]], str],
    lead: list[tuple[str, str]] | None = None,
) -> tuple[str, list[tuple[int, int, int]]]:
    """The rendered turns, and for each (start of its span, start of its text, end of its text).

    A turn's span is what its prefix's output has beyond the one before. Inside it, what stays the
    same when other texts stand in the turn's place lies before and after the text. All prefixes
    stand behind the turns of ``lead``, whose own output is part of the result but has no span.
    """
    lead = lead or []
    spans, done = [], render(lead)
    for k, (role, text) in enumerate(turns):
        before = [*lead, *turns[:k]]
        now = render([*before, (role, text)])
        if not now.startswith(done):
            raise RewritesHistory(f"turn {k}")
        probes = [render([*before, (role, probe)]) for probe in PROBES]
        if not all(p.startswith(done) for p in probes):
            raise RewritesHistory(f"turn {k}")
        one, two = (p[len(done) :] for p in probes)
        head = next((i for i, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))
        tail = next(
            (i for i, (x, y) in enumerate(zip(reversed(one), reversed(two))) if x != y),
            min(len(one), len(two)),
        )
        tail = min(tail, len(now) - len(done) - head)
        spans.append((len(done), len(done) + head, len(now) - tail))
        done = now
    return done, spans


PIECE_SCHEMA = (
    "conv bigint, stretch bigint, number bigint, n_turns bigint, formatted string,"
    " loss array<struct<start:bigint,stop:bigint>>, rewrites boolean"
)


def _stretches(rows: DataFrame, piece: int, scratch: Scratch) -> DataFrame:
    """``(in_conv, in_bucket, stretch, last, next)`` for buckets of conversations of over ``piece`` rows.

    A bucket holds the rows of ``piece`` neighbouring turn numbers. Its stretch follows from the
    number of rows before it, counted from the conversation's first; ``next`` is the stretch after
    it, if another, and ``last`` the turn before that. Only counts and turn numbers are shuffled.
    """
    buckets = scratch.store(
        rows.groupBy("conv", "bucket").agg(F.count("*").alias("n"), F.max("turn").alias("last")),
        "buckets",
    )
    long = buckets.groupBy(F.col("conv").alias("_conv")).agg(F.sum("n").alias("_all"))
    own = buckets.join(
        long.where(F.col("_all") > piece), F.col("conv").eqNullSafe(F.col("_conv")), "left_semi"
    ).withColumn("name", F.coalesce(F.col("conv").cast("string"), F.lit("")))
    placed = running_total(own, "name", "bucket", "n", "before")
    stretch = F.floor(F.col("before") / piece)
    after = F.floor((F.col("before") + F.col("n")) / piece)
    return scratch.store(
        placed.select(
            F.col("conv").alias("in_conv"),
            F.col("bucket").alias("in_bucket"),
            stretch.alias("stretch"),
            "last",
            F.when(after > stretch, after).alias("next"),
        ),
        "stretches",
    )


def format_conversations(
    conversations: DataFrame,
    render: Callable[[list[tuple[str, str]]], str] = marked_turns,
    loss_role: str = LOSS_ROLE,
    piece: int = PIECE,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``(conv, piece, n_turns, formatted, loss, rewrites)``: a conversation in order of its pieces.

    A piece has at most ``piece`` rows; a conversation of no more rows is one piece, a longer one is
    cut by the number of rows from its first. The pieces of a conversation, joined, are its
    formatted text. So a conversation of any length is spread over tasks, and rendering every prefix
    of a piece stays linear in the turns. ``loss`` has the stretches of ``formatted`` under the loss
    mask: the texts of ``loss_role``.

    A later piece is rendered behind the turn before it, so a template may add something before the
    first turn, which stands once, in the first piece, and may look one turn back. A piece in which
    more turns changed what the template had made of those before, that one turn included, has
    ``rewrites`` true and null in place of text and stretches.

    Rows go by turn, nulls first, then by role and text; repeated rows are turns of their own. Null
    roles and texts are empty. Rows with a null conversation form one. Other columns are not read.
    """
    scratch = Scratch(conversations.sparkSession)
    rows = conversations.select(
        F.col(conv).cast("bigint").alias("conv"),
        F.coalesce(F.floor(F.col(turn) / piece), F.lit(NO_TURN)).cast("bigint").alias("bucket"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # Short conversations have no row here; those of long ones are told where they are cut.
    cut = _stretches(rows.select("conv", "bucket", "turn"), piece, scratch)
    joined = rows.join(
        cut,
        F.col("conv").eqNullSafe(F.col("in_conv")) & (F.col("bucket") == F.col("in_bucket")),
        "left",
    )
    own = F.struct(F.coalesce("stretch", F.lit(0)).alias("stretch"), F.lit(1).alias("own"))
    # The turn before a cut goes along with the stretch after it, to be rendered behind.
    leads = F.col("next").isNotNull() & F.col("turn").eqNullSafe(F.col("last"))
    lead = F.struct(F.col("next").alias("stretch"), F.lit(0).alias("own"))
    placed = joined.select(
        "conv", F.explode(F.when(leads, F.array(own, lead)).otherwise(F.array(own))).alias("at"),
        "turn", "role", "text",
    ).select("conv", "at.stretch", "at.own", "turn", "role", "text")

    def made(key, number, lead, turns):
        try:
            formatted, spans = turn_spans(turns, render, lead)
        except RewritesHistory:
            return (*key, number, len(turns), None, None, True)
        shift = len(render(lead)) if lead else 0
        loss = [
            {"start": begin - shift, "stop": end - shift}
            for (_, begin, end), (who, _) in zip(spans, turns)
            if who == loss_role
        ]
        return (*key, number, len(turns), formatted[shift:], loss, False)

    def format_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [*[pa.int64()] * 4, pa.string(), stretches, pa.bool_()]
        names = ["conv", "stretch", "number", "n_turns", "formatted", "loss", "rewrites"]

        def batch_of(pieces):
            return pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(zip(*pieces), kinds)], names
            )

        key, number, lead, turns, pieces = None, 0, [], [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]
            for c, s, is_own, who, said in zip(*columns):
                if key != (c, s):
                    if turns:
                        pieces.append(made(key, number, lead, turns))
                    key, number, lead, turns = (c, s), 0, [], []
                if not is_own:
                    lead = [(who, said)]
                    continue
                if len(turns) == piece:
                    pieces.append(made(key, number, lead, turns))
                    number, lead, turns = number + 1, turns[-1:], []
                turns.append((who, said))
            if pieces:
                yield batch_of(pieces)
                pieces = []
        if turns:
            yield batch_of([made(key, number, lead, turns)])

    n = partitions(conversations.sparkSession)
    pieces = (
        placed.repartition(n, "conv", "stretch")
        .sortWithinPartitions("conv", "stretch", "own", "turn", "role", "text")
        .mapInArrow(format_sorted, PIECE_SCHEMA)
    )
    return pieces.select(
        F.col("conv").alias(conv),
        F.struct("stretch", "number").alias("piece"),
        "n_turns",
        "formatted",
        "loss",
        "rewrites",
    )


DIGEST_SCHEMA = (
    "conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint"
)


def conversation_digests(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read formatted conversations back: one row of counts and digests for each.

    Digests run over a conversation from its first to its last turn, so its pieces pass through one
    task in order, one batch at a time in memory. A conversation that its template rewrote has null
    digests.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [column.split()[0] for column in DIGEST_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        nothing = object()

        def closed(key, state):
            turns, digest, loss_chars, loss, chars, whole = state
            return (key, turns, *(
                (digest.hexdigest(), loss_chars, loss.hexdigest(), chars) if whole else (None,) * 4
            ))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names
            )

        key, state, rows = nothing, None, []
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("conv", "formatted", "loss", "n_turns")]
            for conv_key, formatted, loss, n in zip(*columns):
                if key is nothing or conv_key != key:
                    if key is not nothing:
                        rows.append(closed(key, state))
                    key, state = conv_key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                state[0] += n
                if formatted is None:
                    state[5] = False
                    continue
                for who, said in read_turns(formatted):
                    state[1].update(f"{who}\n{said}\n".encode("utf-8", "surrogatepass"))
                for stretch in loss:
                    said = unescape(formatted[stretch["start"] : stretch["stop"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if rows:
                yield batch_of(rows)
                rows = []
        if key is not nothing:
            yield batch_of([closed(key, state)])

    dealt = pieces.select(F.col(conv).alias("conv"), "piece", "n_turns", "formatted", "loss")
    return (
        dealt.repartition(partitions(pieces.sparkSession), "conv")
        .sortWithinPartitions("conv", "piece")
        .mapInArrow(fold, DIGEST_SCHEMA)
        .withColumnRenamed("conv", conv)
    )
