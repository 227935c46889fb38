"""Where the tokens of two tokenisers meet: groups between common ends, and overlapping pairs.

The ends of a text's tokens are two rising lists of byte offsets. The shorter list drives a
galloping search in the longer one: steps double until they pass the end that is sought, then
halving finds its rank. Common ends cut both lists into groups; differences of ranks say how many
tokens of one side a token of the other overlaps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch
from foretoken.llm.sequence_packing import SETTLED, SPLIT

# Bytes of text whose links share one list of different pairs.
BLOCK_BYTES = 16 << 20
# Bits of an id of the second tokeniser inside a pair.
ID_BITS = 32


def byte_level_tokens(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """Encoder of a byte-level BPE file and the bytes of every id; nothing in a text is special.

    Texts of settled characters go through a faster library with the same vocabulary and merges.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = {t["content"] for t in made["added_tokens"]}
    # The printable stand-ins of bytes: printable ones stand for themselves, others from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    spelled = [b""] * own.get_vocab_size()
    for token, i in own.get_vocab().items():
        spelled[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
    ranks = {spelled[i]: i for token, i in made["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("fast", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            fast.encode_ordinary(text)
            if SETTLED.fullmatch(text)
            else own.encode(text, add_special_tokens=False).ids
            for text in texts
        ]

    return encode, spelled


def piece_tokens(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """Encoder of a piece model, which puts a space before a text, and the bytes of every id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [
        bytes([int(model.id_to_piece(i)[3:5], 16)])
        if model.is_byte(i)
        else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]
    return lambda texts: model.encode(texts, num_threads=1), spelled


def gallop(longer: np.ndarray, keys: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each key, how many values of the rising list ``longer`` lie below it.

    Every key sets out from its own ``start``, in steps that double until the key lies between two
    of them; what is left between is halved. The cost follows the distance, not the list.
    """
    low = np.zeros(len(keys), np.int64)
    high = np.full(len(keys), len(longer), np.int64)
    at = np.clip(start, 0, max(len(longer) - 1, 0))
    below = longer[at] < keys if len(longer) else np.zeros(len(keys), bool)
    for side in (True, False):
        todo = np.flatnonzero(below == side)
        origin, step = at[todo], 1
        (low if side else high)[todo] = origin + side
        while len(todo):
            probe = origin + step if side else origin - step
            inside = (probe < len(longer)) & (probe >= 0)
            todo, origin, probe = todo[inside], origin[inside], probe[inside]
            on = (longer[probe] < keys[todo]) == side
            if side:
                low[todo[on]] = probe[on] + 1
                high[todo[~on]] = probe[~on]
            else:
                high[todo[on]] = probe[on]
                low[todo[~on]] = probe[~on] + 1
            todo, origin, step = todo[on], origin[on], 2 * step
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) >> 1
        less = longer[middle] < keys[todo]
        low[todo[less]] = middle[less] + 1
        high[todo[~less]] = middle[~less]
        todo = todo[low[todo] < high[todo]]
    return low


def ranks_of_ends(
    a: np.ndarray, b: np.ndarray, texts_a: np.ndarray, texts_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For every end in ``a``: how many ends in ``b`` lie below it, and whether it is one of them.

    Both lists hold the ends of several texts, one after the other; ``texts_a`` and ``texts_b`` are
    where the tokens of each text begin, and their number at last. In each text the shorter list is
    searched for in the longer one.
    """
    sizes_a, sizes_b = np.diff(texts_a), np.diff(texts_b)
    drives_a = sizes_a <= sizes_b
    below, common = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    for drives, short, long, starts_short, starts_long, sizes_short, sizes_long in (
        (drives_a, a, b, texts_a, texts_b, sizes_a, sizes_b),
        (~drives_a, b, a, texts_b, texts_a, sizes_b, sizes_a),
    ):
        chosen = np.flatnonzero(np.repeat(drives, sizes_short))
        if not len(chosen):
            continue
        text = np.repeat(np.arange(len(sizes_short)), sizes_short)[chosen]
        inside = chosen - starts_short[text]
        guess = starts_long[text] + inside * sizes_long[text] // np.maximum(sizes_short[text], 1)
        rank = gallop(long, short[chosen], guess)
        met = (rank < len(long)) & (long[np.minimum(rank, len(long) - 1)] == short[chosen])
        if short is a:
            below[chosen], common[chosen] = rank, met
        else:
            # The other way round: an end in b counts for all ends in a from the first above it on.
            passed = np.cumsum(np.bincount(rank + met, minlength=len(a) + 1))[: len(a)]
            others = np.flatnonzero(np.repeat(drives, sizes_long))
            of = np.repeat(np.arange(len(sizes_long)), sizes_long)[others]
            # Ends in b of driving texts only were counted; those of the texts before are all below.
            left_out = np.concatenate([[0], np.cumsum(np.where(drives, 0, sizes_short))])
            below[others] = passed[others] + left_out[of]
            common[rank[met]] = True
    return below, common


@dataclass
class Alignment:
    """Tokens of several texts: ids of both sides, where each text's begin (and end at last), and
    per text's tokens the group they are in; links as first and number of b tokens per a token."""

    a: np.ndarray
    b: np.ndarray
    texts_a: np.ndarray
    texts_b: np.ndarray
    ends_a: np.ndarray
    below: np.ndarray
    common: np.ndarray

    def group_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """How many a tokens, and b tokens, lie before the end of each group."""
        met = np.flatnonzero(self.common)
        return met + 1, self.below[met] + 1

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """For each a token its first overlapping b token and how many there are."""
        first = np.concatenate([[0], (self.below + self.common)[:-1]]).astype(np.int64)[: len(self.a)]
        return first, self.below - first + 1

    def per_text(self, values_of_a: np.ndarray) -> np.ndarray:
        """Sums over the a tokens of each text."""
        total = np.concatenate([[0], np.cumsum(values_of_a, dtype=np.int64)])
        return np.diff(total[self.texts_a])


def align_texts(texts: list[str | None], encoders) -> Alignment:
    """Align texts; one that is null or empty, or that either side does not give back, has no tokens."""
    (encode_a, bytes_a), (encode_b, bytes_b) = encoders
    given = [i for i, text in enumerate(texts) if text]
    spaced = [" " + texts[i] for i in given]
    sides_a, sides_b = [[]] * len(texts), [[]] * len(texts)
    for i, text, a, b in zip(given, spaced, encode_a(spaced), encode_b([texts[i] for i in given])):
        raw = text.encode()
        if b"".join(map(bytes_a.__getitem__, a)) == raw and b"".join(map(bytes_b.__getitem__, b)) == raw:
            sides_a[i], sides_b[i] = a, b
    ids, starts, ends = [], [], []
    for side, spelled in ((sides_a, bytes_a), (sides_b, bytes_b)):
        starts.append(np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64))
        flat = np.fromiter(chain.from_iterable(side), np.int64, int(starts[-1][-1]))
        ids.append(flat)
        ends.append(np.cumsum(np.array([len(s) for s in spelled], np.int64)[flat]))
    below, common = ranks_of_ends(ends[0], ends[1], starts[0], starts[1])
    return Alignment(ids[0], ids[1], starts[0], starts[1], ends[0], below, common)


def align_documents(
    documents: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, a_ids, b_ids, a_ends, b_ends, byte_ends)``: the tokens of both sides and, per group,
    how many a tokens, b tokens and bytes (of a space and the text) lie before its end.

    ``path_a`` is a byte-level BPE file, ``path_b`` a piece model. A text that is null or empty, or
    that either side does not give back byte by byte, has empty lists. Null and repeated keys each
    give a row; other columns are not read.
    """

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = byte_level_tokens(path_a), piece_tokens(path_b)
        for batch in batches:
            for row in range(batch.num_rows):
                found = align_texts([batch.column(1)[row].as_py()], encoders)
                cuts_a, cuts_b = found.group_ends()
                columns = (found.a, found.b, cuts_a, cuts_b, found.ends_a[cuts_a - 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), *[pa.array([c], pa.list_(pa.int64())) for c in columns]],
                    ["key", "a_ids", "b_ids", "a_ends", "b_ends", "byte_ends"],
                )

    lists = "a_ids array<bigint>, b_ids array<bigint>, a_ends array<bigint>, b_ends array<bigint>"
    return (
        documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(aligned, f"key bigint, {lists}, byte_ends array<bigint>")
        .withColumnRenamed("key", key)
    )


def _spelled_ids(size: int, separator: str) -> np.ndarray:
    """Every id in decimal with a separator after it, as rows of bytes padded with zeros."""
    return np.array([f"{i}{separator}".encode() for i in range(size)], "S").view(np.uint8).reshape(size, -1)


class GroupDigests:
    """SHA-256 of each text's groups, written ``a1,a2|b1;a3|b2,b3`` in decimal ids."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.a = [_spelled_ids(size_a, s) for s in ",|"]
        self.b = [_spelled_ids(size_b, s) for s in ",;"]

    def of(self, found: Alignment) -> list[str]:
        cuts_a, cuts_b = found.group_ends()
        sizes_a, sizes_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        # A token stands behind all tokens of groups before; in its group, a tokens come first.
        at_a = np.arange(len(found.a)) + np.repeat(cuts_b - sizes_b, sizes_a)
        at_b = np.arange(len(found.b)) + np.repeat(cuts_a, sizes_b)
        width = max(t.shape[1] for t in (*self.a, *self.b))
        cells = np.zeros((len(found.a) + len(found.b), width), np.uint8)
        for table, ids, at, cuts in ((self.a, found.a, at_a, cuts_a), (self.b, found.b, at_b, cuts_b)):
            cells[at, : table[0].shape[1]] = table[0][ids]
            last = cuts - 1
            cells[at[last], : table[1].shape[1]] = table[1][ids[last]]
        shown = cells.ravel()
        kept = np.concatenate([[0], np.cumsum((cells != 0).sum(axis=1))])
        written = shown[shown != 0].tobytes()
        starts = kept[found.texts_a + found.texts_b].tolist()
        return [
            hashlib.sha256(written[begin : end - 1]).hexdigest() if end > begin else ""
            for begin, end in zip(starts[:-1], starts[1:])
        ]


BLOCK_SCHEMA = (
    "block bigint, docs array<struct<key: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, "
    "n_links: bigint, groups_sha256: string>>, steps binary, times binary, per_doc binary, "
    "pairs array<bigint>, held array<bigint>"
)
DIGEST_SCHEMA = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
    "count_sum bigint, groups_sha256 string"
)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, compressed; their size goes in front."""
    raw = values.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b""
    return np.frombuffer(raw, "<u4").astype(np.int64)


def _block_maker(path_a: str, path_b: str, block_bytes: int):
    """Turn documents into block rows: what each text's alignment comes to, and per text its
    different linked pairs as places in the block's list of them, with how often it has each."""

    def made(block: int, keys: list, parts: list) -> pa.RecordBatch:
        docs, pairs, texts = [], [], []
        base = 0
        for found_docs, found_pairs, text in parts:
            docs.extend(found_docs)
            pairs.append(found_pairs)
            texts.append(text + base)
            base += len(found_docs)
        pairs, texts = np.concatenate(pairs), np.concatenate(texts)
        known, place = np.unique(pairs, return_inverse=True)
        linked, times = np.unique(texts * max(len(known), 1) + place, return_counts=True)
        place, text = linked % max(len(known), 1), linked // max(len(known), 1)
        per_doc = np.bincount(text, minlength=len(docs))
        # Places rise inside a text: steps between them are small.
        steps = np.diff(place, prepend=0)
        first = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
        steps[first] = place[first]
        held = np.bincount(place, minlength=len(known))
        docs = [{"key": k, **d} for k, d in zip(keys, docs)]
        schema = pa.schema([
            ("block", pa.int64()),
            ("docs", pa.list_(pa.struct([
                ("key", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                ("n_links", pa.int64()), ("groups_sha256", pa.string()),
            ]))),
            ("steps", pa.binary()), ("times", pa.binary()), ("per_doc", pa.binary()),
            ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())),
        ])
        row = [[block], [docs], [_pack(steps)], [_pack(times)], [_pack(per_doc)], [known], [held]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = byte_level_tokens(path_a), piece_tokens(path_b)
        digests = GroupDigests(len(encoders[0][1]), len(encoders[1][1]))
        # The task's number tells its blocks from those of others; what is read later is what one
        # finished attempt of the task has written.
        task, nth = TaskContext.get().partitionId(), 0
        keys, parts, held = [], [], 0

        def aligned(texts: list[str | None]):
            found = align_texts(texts, encoders)
            first, n = found.links()
            of = np.repeat(np.arange(len(found.a)), n)
            other = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
            text = np.repeat(np.arange(len(texts)), found.per_text(n))
            columns = (
                np.diff(found.texts_a).tolist(), np.diff(found.texts_b).tolist(),
                found.per_text(found.common).tolist(), found.per_text(n).tolist(), digests.of(found),
            )
            names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            docs = [dict(zip(names, row)) for row in zip(*columns)]
            return docs, (found.a[of] << ID_BITS) | found.b[other], text

        for batch in batches:
            texts, begin = batch.column(1).to_pylist(), 0
            sizes = [len(t or "") for t in texts]
            while begin < len(texts):
                # Texts go through together up to a sixteenth of a block.
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + sizes[end] <= block_bytes >> 4):
                    size += sizes[end]
                    end += 1
                keys.extend(batch.column(0).slice(begin, end - begin).to_pylist())
                parts.append(aligned(texts[begin:end]))
                begin, held = end, held + size
                if held >= block_bytes:
                    yield made((task << 32) + nth, keys, parts)
                    keys, parts, held, nth = [], [], 0, nth + 1
        if keys:
            yield made((task << 32) + nth, keys, parts)

    return blocks


def alignment_digests(
    documents: DataFrame,
    path_a: str,
    path_b: str,
    key: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """What each text's alignment comes to, with corpus-wide counts of its linked pairs of ids.

    ``n_links`` are all overlapping pairs of tokens; the count of a pair of ids is in how many
    documents it is linked; ``count_sum`` adds it up over the links, ``n_best`` tells how many links
    have the highest count of all pairs with their a id. Texts are handled as in
    :func:`align_documents`; repeated rows are documents of their own, no row gives no row.

    Texts are read once. A block of them keeps its different pairs with the number of documents that
    hold each: those are summed up over the corpus, and every block is sent the totals of its own
    pairs. What a document links is kept as compressed places in its block's list.
    """
    scratch = Scratch(documents.sparkSession)
    given = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    blocks = scratch.store(
        given.mapInArrow(_block_maker(path_a, path_b, block_bytes), BLOCK_SCHEMA), "blocks"
    )
    listed = blocks.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("p")).select(
        "block", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held")
    )
    counts = scratch.store(listed.groupBy("pair").agg(F.sum("held").alias("n")), "pair_counts")
    a_id = F.shiftright("pair", ID_BITS)
    # At most one row for each id of the vocabulary.
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    told = counts.join(most, a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    sent = listed.join(told, "pair").select(F.col("block").alias("to"), "pair", "n", "best")

    def totals(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.sort_by("pair")
        n, best = known.column("n").to_numpy(), known.column("best").to_numpy()
        out = []
        for row in range(left.num_rows):
            steps, times, per_doc = (_unpack(left.column(c)[row].as_py()) for c in ("steps", "times", "per_doc"))
            ends = np.cumsum(per_doc)
            starts = ends - per_doc
            # Steps are summed up from the start of each text.
            run = np.concatenate([[0], np.cumsum(steps)])
            place = run[1:] - np.repeat(run[starts], per_doc)
            values = []
            for value in (n, best):
                total = np.concatenate([[0], np.cumsum(times * value[place].astype(np.int64))])
                values.append(total[ends] - total[starts])
            docs = left.column("docs").combine_chunks()[row].values
            key, n_a, n_b, n_groups, n_links, groups_sha256 = docs.flatten()
            columns = [key, n_a, n_b, n_groups, n_links, values[1], values[0], groups_sha256]
            names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
            out.append(pa.table([pa.array(c) for c in columns], names))
        return pa.concat_tables(out)

    kept = blocks.select("block", "docs", "steps", "times", "per_doc")
    made = kept.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(totals, DIGEST_SCHEMA)
    return made.withColumnRenamed("doc_id", key)
