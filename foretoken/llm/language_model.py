"""N-gram scoring of whole texts by a weighted backoff automaton over counts of the whole corpus.

The model interpolates each order with the next lower one by a Dirichlet prior::

    P(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | h) = (c(h w) + mu P(w | h')) / (c(h) + mu)        h' = h without its first token

For a history that was never seen it is P(w | h'). A seen n-gram is an arc with that weight; any
other token takes the failure arc of its state, weight mu / (c(h) + mu), to the state of h'. No
n-gram is pruned.

No table of all n-grams is held anywhere. Texts are cut into blocks of bounded size. A block sends
its distinct n-grams with their training counts, as sorted runs of 64-bit hashes, to buckets of the
hash space; a bucket adds up the counts of all blocks and returns to each the totals of what it
sent. A block then holds every n-gram that its own texts can reach. Part by part of its tokens it
builds that piece of the automaton and traverses the texts, long ones in several lanes, from left to
right side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch, in_fold

# A block closes once it holds this many bytes of text.
BLOCK_BYTES = 12 << 20
# Hashes of one order that a bucket of the hash space receives, about.
BUCKET_KEYS = 1 << 18
# Tokens that one lane of the traversal reads.
LANE = 512
# Tokens of a block whose n-grams a task sorts, and whose automaton it holds, at a time.
PART_TOKENS = 1 << 18
SMOOTH = 0.1
# The first two types of every block.
END, START = 0, 1
END_HASH = xxhash.xxh64_intdigest(b" ")  # no word holds a space
START_HASH = xxhash.xxh64_intdigest(b"\n")

BLOCK_SCHEMA = (
    "block bigint, keys array<bigint>, trained array<boolean>, held_out array<boolean>,"
    " lengths binary, tokens binary, types binary, n_tokens bigint"
)


class _Types(dict):
    def __missing__(self, word):
        self[word] = number = len(self) + 2
        return number


def _block(number, keys, trained, held, lengths, tokens, types) -> pa.RecordBatch:
    hashes = np.fromiter(
        (END_HASH, START_HASH, *map(xxhash.xxh64_intdigest, types)), np.uint64, len(types) + 2
    )
    flat = np.concatenate(tokens)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([keys], pa.list_(pa.int64())),
            pa.array([trained], pa.list_(pa.bool_())),
            pa.array([held], pa.list_(pa.bool_())),
            pa.array([np.array(lengths, "<i4").tobytes()], pa.binary()),
            pa.array([flat.astype("<u4").tobytes()], pa.binary()),
            pa.array([hashes.astype("<u8").tobytes()], pa.binary()),
            pa.array([len(flat)], pa.int64()),
        ],
        ["block", "keys", "trained", "held_out", "lengths", "tokens", "types", "n_tokens"],
    )


def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, trained, held_out) to blocks of numbered words; a text stays in one block."""
    number = TaskContext.get().partitionId() << 32
    keys, trained, held, lengths, tokens, types, size = [], [], [], [], [], _Types(), 0
    for batch in batches:
        for key, text, learn, out in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = (text or "").encode("utf-8", "surrogatepass").lower()
            ids = np.array([START, *map(types.__getitem__, raw.split()), END], np.uint32)
            keys.append(key)
            trained.append(learn)
            held.append(out)
            lengths.append(len(ids))
            tokens.append(ids)
            size += len(raw) + 64
            if size >= BLOCK_BYTES:
                yield _block(number, keys, trained, held, lengths, tokens, types)
                number += 1
                keys, trained, held, lengths, tokens, types, size = [], [], [], [], [], _Types(), 0
    if keys:
        yield _block(number, keys, trained, held, lengths, tokens, types)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from the hash of all but its last token and that of the last."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class _Block:
    """The texts of a block, cut into lanes. A text is its start, its words and its end.

    A lane is up to ``LANE`` tokens of one text, read from ``begin`` and counted from ``own``: a
    later lane of a text first reads the tokens before it that decide its state.
    """

    def __init__(self, row: dict, order: int) -> None:
        self.order = order
        self.lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        self.tokens = np.frombuffer(row["tokens"], "<u4")
        self.types = np.frombuffer(row["types"], "<u8")
        self.trained = np.array(row["trained"], bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        lane = max(LANE, order)
        counts = -(-(self.lengths - 1) // lane)
        self.text = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = self.starts[self.text] + 1 + nth * lane
        self.first = nth == 0
        self.own = np.where(self.first, at - 1, at)
        self.begin = np.where(self.first, at - 1, at - (order - 1))
        self.end = np.minimum(at + lane, (self.starts + self.lengths)[self.text])

    def parts(self) -> Iterator[_Part]:
        """Neighbouring lanes of about ``PART_TOKENS`` tokens at a time."""
        size, low = np.cumsum(self.end - self.own), 0
        while low < len(size):
            full = (size[low - 1] if low else 0) + PART_TOKENS
            high = max(low + 1, int(np.searchsorted(size, full, side="right")))
            yield _Part(self, low, high)
            low = high


class _Part:
    """The tokens of some lanes, each with the hash of the n-gram of every order that ends in it.

    ``grams[k - 1]`` has the positions at which an n-gram of order k ends, and its hash. Tokens from
    ``own`` on are in no part before.
    """

    def __init__(self, block: _Block, low: int, high: int) -> None:
        at = block.begin[low]
        self.order, self.n_types = block.order, len(block.types)
        self.lane_text, self.first = block.text[low:high], block.first[low:high]
        self.begin, self.end = block.begin[low:high] - at, block.end[low:high] - at
        self.own = int(block.own[low] - at)
        self.tokens = block.tokens[at : block.end[high - 1]].astype(np.int64)
        self.texts = slice(int(self.lane_text[0]), int(self.lane_text[-1]) + 1)
        starts = np.maximum(block.starts[self.texts] - at, 0)
        lengths = np.diff(starts, append=len(self.tokens))
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.trained = np.repeat(block.trained[self.texts], lengths)
        depth = np.arange(len(self.tokens)) - np.repeat(starts, lengths)
        hashes = block.types[self.tokens]
        self.grams = [(np.arange(len(hashes)), hashes)]
        last = hashes
        for k in range(2, self.order + 1):
            gram = np.empty_like(hashes)
            gram[1:] = _mix(last[:-1], hashes[1:])
            at = np.flatnonzero(depth >= k - 1)
            self.grams.append((at, gram[at]))
            last = gram

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words and ends that are in no part before, for each text."""
        values = np.where(self.tokens != START, values, 0)[self.own :]
        return np.bincount(self.text[self.own :], weights=values, minlength=self.texts.stop - self.texts.start)


def distinct_grams(block: _Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every order the block's distinct hashes, ascending, with their training counts."""
    runs = [[] for _ in range(block.order)]
    for part in block.parts():
        for (at, gram), run in zip(part.grams, runs):
            own = np.searchsorted(at, part.own)
            keys, place = np.unique(gram[own:], return_inverse=True)
            counts = np.bincount(place[part.trained[at[own:]]], minlength=len(keys))
            run.append((keys, counts.astype(np.uint32)))  # a part has few tokens
    return [_added(runs.pop(0)) for _ in range(block.order)]


def _added(run: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One run of distinct keys from several that rise."""
    keys, counts = (np.concatenate(of) for of in zip(*run))
    run.clear()
    sort = np.argsort(keys, kind="stable")
    keys, counts = keys[sort], counts[sort]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    return counts.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max)).tobytes()


def _counts(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


SENT_SCHEMA = "bucket int, level int, block bigint, keys binary, counts binary"
TOTAL_SCHEMA = "bucket int, level int, block bigint, totals binary, n bigint, v bigint"


def sender(order: int, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for level, (keys, counts) in enumerate(distinct_grams(_Block(row, order))):
                    cuts = _cuts(keys, bits)
                    full = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full, pa.int32()),
                            pa.array([level] * len(full), pa.int32()),
                            pa.array([row["block"]] * len(full), pa.int64()),
                            pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                            pa.array([_narrow(counts[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
                        ],
                        ["bucket", "level", "block", "keys", "counts"],
                    )

    return send


def add_up(sent: pa.Table) -> pa.Table:
    """Totals over all blocks of one bucket, returned to each block for the keys it sent."""
    out = {name: [] for name in ("bucket", "level", "block", "totals", "n", "v")}
    bucket = sent.column("bucket")[0].as_py()
    levels = sent.column("level").to_numpy()
    blocks = sent.column("block").to_numpy()
    for level in np.unique(levels).tolist():
        rows = np.flatnonzero(levels == level)
        keys = [np.frombuffer(sent.column("keys")[int(i)].as_buffer(), "<u8") for i in rows]
        counts = [
            _counts(sent.column("counts")[int(i)].as_py(), len(k)) for i, k in zip(rows, keys)
        ]
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        # Integer sums, exact at any size.
        totals = np.zeros(len(unique), np.int64)
        np.add.at(totals, place, np.concatenate(counts))
        at = 0
        for i, k in zip(rows, keys):
            out["totals"].append(_narrow(totals[place[at : at + len(k)]]))
            at += len(k)
        out["bucket"] += [bucket] * len(rows)
        out["level"] += [level] * len(rows)
        out["block"] += blocks[rows].tolist()
        # Tokens and types of the training texts, told once for each bucket.
        told = totals[unique != START_HASH] if level == 0 else totals[:0]
        out["n"] += [int(told.sum())] + [0] * (len(rows) - 1)
        out["v"] += [int((told > 0).sum())] + [0] * (len(rows) - 1)
    return pa.table(
        [
            pa.array(out["bucket"], pa.int32()),
            pa.array(out["level"], pa.int32()),
            pa.array(out["block"], pa.int64()),
            pa.array(out["totals"], pa.binary()),
            pa.array(out["n"], pa.int64()),
            pa.array(out["v"], pa.int64()),
        ],
        names=list(out),
    )


class Automaton:
    """The part of the model that some lanes of a block can reach.

    State 0 is the empty history; every other state is a seen n-gram below the highest order that
    can go on. Arcs are sorted by (state, token). The target of an arc, like that of a failure arc,
    is the longest seen history. ``totals`` has the block's distinct hashes of every order and
    their totals.
    """

    def __init__(
        self, part: _Part, totals: list[tuple[np.ndarray, np.ndarray]], n: int, v: int, mu: float
    ) -> None:
        self.part, order = part, part.order
        self.n_types = part.n_types
        arcs, weights, targets = [], [], []
        fails, fail_weights = [np.zeros(1, np.int64)], [np.zeros(1)]
        n_states = 1
        for k, ((at, gram), (keys, of_block)) in enumerate(zip(part.grams, totals), 1):
            found, first, place = np.unique(gram, return_index=True, return_inverse=True)
            seen = of_block[np.searchsorted(keys, found)]
            token = part.tokens[at[first]]
            of = np.full(len(part.tokens), -1, np.int64)
            of[at] = place
            if k == 1:
                history = np.zeros(len(first), np.int64)
                chance = (seen + SMOOTH) / (n + SMOOTH * (v + 1))
                shorter = np.zeros(len(first), np.int64)
                exists = token != START
                self.known, self.base = seen[place], np.log10(chance)[place]
            else:
                before, suffix = lower_of[at[first] - 1], lower_of[at[first]]
                history = lower_state[before]
                chance = (seen + mu * lower_chance[suffix]) / (lower_seen[before] + mu)
                shorter = lower_longest[suffix]
                exists = seen > 0
            state = np.full(len(first), -1, np.int64)
            if k < order:
                live = (seen > 0) & (token != END)
                state[live] = n_states + np.arange(live.sum())
                n_states += int(live.sum())
                fails.append(shorter[live])
                fail_weights.append(np.log10(mu / (seen[live] + mu)))
            longest = np.where(state >= 0, state, shorter)
            if k == 1:
                started = longest[token == START]
                self.start = int(started[0]) if len(started) else 0
            arcs.append((history * self.n_types + token)[exists])
            weights.append(np.log10(chance[exists]))
            targets.append(longest[exists])
            lower_of, lower_state, lower_longest = of, state, longest
            lower_chance, lower_seen = chance, seen
        flat = np.concatenate(arcs)
        sort = np.argsort(flat)
        self.arcs = flat[sort]
        self.weights = np.concatenate(weights)[sort]
        self.targets = np.concatenate(targets)[sort]
        self.fails = np.concatenate(fails)
        self.fail_weights = np.concatenate(fail_weights)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one token in every lane: the states after it and the log10 weights on the way."""
        state, gain, after = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        waiting = np.arange(len(state))
        while len(waiting):
            want = state[waiting] * self.n_types + token[waiting]
            arc = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
            hit = self.arcs[arc] == want
            done, arc = waiting[hit], arc[hit]
            gain[done] += self.weights[arc]
            after[done] = self.targets[arc]
            waiting = waiting[~hit]
            gain[waiting] += self.fail_weights[state[waiting]]
            state[waiting] = self.fails[state[waiting]]
        return after, gain

    def scores(self) -> np.ndarray:
        """log10 probability of what the lanes have of every text, all read side by side."""
        part = self.part
        skip = np.where(part.first, 0, part.order - 1)
        # The start of a text is not read: it is the state in which its first lane begins.
        begin = part.begin + part.first
        size = part.end - begin
        order = np.argsort(-size, kind="stable")
        text, begin, size, skip = part.lane_text[order], begin[order], size[order], skip[order]
        state = np.where(part.first[order], self.start, 0)
        total = np.zeros(len(text))
        active = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")
        for step, m in enumerate(active.tolist()):
            state[:m], gain = self.step(state[:m], part.tokens[begin[:m] + step])
            total[:m] += np.where(step >= skip[:m], gain, 0.0)
        first, stop = part.texts.start, part.texts.stop
        return np.bincount(text - first, weights=total, minlength=stop - first)


SCORE_SCHEMA = (
    "key bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
    " base_score double, score double"
)


def scorer(order: int, bits: int, n: int, v: int, mu: float):
    def score(blocks: pa.Table, sums: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        block = _Block(row, order)
        levels, buckets = sums.column("level").to_numpy(), sums.column("bucket").to_numpy()
        totals = []
        for level, (keys, _) in enumerate(distinct_grams(block)):
            cuts = _cuts(keys, bits)
            filled = np.zeros(len(keys), np.int64)
            for i in np.flatnonzero(levels == level).tolist():
                a, b = cuts[buckets[i]], cuts[buckets[i] + 1]
                filled[a:b] = _counts(sums.column("totals")[i].as_py(), int(b - a))
            totals.append((keys, filled))
        size = len(block.lengths)
        known, base, scores = np.zeros(size), np.zeros(size), np.zeros(size)
        for part in block.parts():
            machine = Automaton(part, totals, n, v, mu)
            known[part.texts] += part.per_text(machine.known > 0)
            base[part.texts] += part.per_text(machine.base)
            scores[part.texts] += machine.scores()
        return pa.table(
            [
                pa.array(row["keys"], pa.int64()),
                pa.array(row["held_out"], pa.bool_()),
                pa.array(block.lengths - 1, pa.int64()),
                pa.array(known.astype(np.int64), pa.int64()),
                pa.array(np.full(size, n), pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(scores, pa.float64()),
            ],
            names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return score


def language_model_scores(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    order: int = 2,
    mu: float = 30.0,
    folds: int = 10,
    held_out: int = 0,
) -> DataFrame:
    """Score every text; learn from those whose crc32(key as text) mod ``folds`` is another.

    A token is a run without ASCII white space, A-Z in lower case; a text ends in one more token.
    Null and empty texts are that token alone. A row with a null key is scored and neither learned
    from nor held out. Repeated rows count and are returned each. Words are told apart by a 64-bit
    hash. Other columns are not read.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    scratch = Scratch(documents.sparkSession)
    out = in_fold(key, folds, held_out)
    rows = documents.select(
        F.col(key).cast("bigint").alias("key"),
        F.col(text).alias("text"),
        (~out & F.col(key).isNotNull()).alias("trained"),
        out.alias("held_out"),
    )
    blocks = scratch.store(rows.mapInArrow(make_blocks, BLOCK_SCHEMA), "blocks")
    n_tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(8, int(n_tokens * order // BUCKET_KEYS).bit_length())
    sent = blocks.mapInArrow(sender(order, bits), SENT_SCHEMA)
    sums = scratch.store(sent.groupBy("bucket").applyInArrow(add_up, TOTAL_SCHEMA), "totals")
    # Two numbers.
    n, v = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    scored = (
        blocks.groupBy("block")
        .cogroup(sums.select("block", "level", "bucket", "totals").groupBy("block"))
        .applyInArrow(scorer(order, bits, n, v, mu), SCORE_SCHEMA)
    )
    return scored.withColumnRenamed("key", key)
