"""Pack whole tokenised texts into sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch, rank_within

LENGTH = 1024
# The id after a document's last token.
END_ID = 0

# Fixed value: the split pattern of byte-level BPE vocabularies of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Latin, Greek and Cyrillic letters and common punctuation: characters of the same class in every
# version of Unicode that a library may be built with.
SETTLED = regex.compile("[\x00-˿Α-ΡΣ-ωЀ-џ‐-‧‰-›€]*")

PIECE_SCHEMA = "key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def tokenizer_ids(path: str) -> Callable[[str], list[int]]:
    """Token ids of a byte-level BPE file, as its own library gives them, without special tokens.

    Texts of settled characters that hold no special token go through a faster library with the
    same vocabulary and merges; all others through the file's own.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    own = None
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = [t["content"] for t in made["added_tokens"]]
    # The printable stand-ins of bytes: printable ones stand for themselves, others from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {
        bytes(byte_of[c] for c in token): rank
        for token, rank in made["model"]["vocab"].items()
        if token not in special
    }
    fast = tiktoken.Encoding("fast", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        nonlocal own
        if SETTLED.fullmatch(text) and not any(s in text for s in special):
            return fast.encode_ordinary(text)
        own = own or Tokenizer.from_file(path)
        return own.encode(text, add_special_tokens=False).ids

    return ids


def cut_lengths(n: int, length: int) -> list[int]:
    """Full sequences first, then the rest: fixed by the document alone."""
    return [length] * (n // length) + ([n % length] if n % length else [])


def piece_maker(path: str, length: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokenizer_ids(path)
        for batch in batches:
            out = [[] for _ in range(5)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.array([*ids(text.as_py() or ""), END_ID], "<u4")
                start = 0
                for size in cut_lengths(len(tokens), length):
                    crc = zlib.crc32(tokens[start : start + size].tobytes())
                    for column, value in zip(out, (key, start, size, crc, len(tokens))):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in out],
                ["key", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return make


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns ``(how many packs, [(length, copies), ...])`` for a histogram of lengths.

    Lengths go longest first, each to the packs with most room left; packs filled alike are one
    pattern with a count, split when only some of them receive. A length that fits nowhere opens
    packs of its own. The work depends on the number of lengths, not on the number of pieces.
    """
    patterns: list[tuple[int, list[tuple[int, int]]]] = []
    room: list[tuple[int, int]] = []  # heap of (-room left, pattern)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if room and -room[0][0] >= size:
                free, at = heapq.heappop(room)
                count, items = patterns[at]
                # All the copies that these packs take before another pack is emptier: one each.
                used = min(left, count)
                if used < count:
                    heapq.heappush(room, (free, len(patterns)))
                    patterns.append((count - used, items))
                grown = (
                    [*items[:-1], (size, items[-1][1] + 1)] if items[-1][0] == size else [*items, (size, 1)]
                )
                patterns[at] = (used, grown)
                if -free - size:
                    heapq.heappush(room, (free + size, at))
                left -= used
            else:
                # A new pack stays the emptiest until nothing more of this length fits.
                copies = capacity // size
                for count, each in ((left // copies, copies), (int(left % copies > 0), left % copies)):
                    if count:
                        if capacity - size * each:
                            heapq.heappush(room, (size * each - capacity, len(patterns)))
                        patterns.append((count, [(size, each)]))
                left = 0
    return patterns


def pattern_segments(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: which sequences and offsets the pieces of these ranks take."""
    rows = []
    used: dict[int, int] = {}
    sequence = 0
    for count, items in patterns:
        offset = 0
        for size, copies in items:
            rank = used.get(size, 0)
            rows.append((size, rank, sequence, offset, copies))
            used[size] = rank + count * copies
            offset += size * copies
        sequence += count
    rows.sort()
    names = ("length", "rank", "sequence", "offset", "copies")
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(names)}


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces of 1 to ``capacity`` tokens."""
    # At most `capacity` rows.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    segments = pattern_segments(shortest_pack_first(histogram, capacity))
    ranked = rank_within(pieces, "length", ["key", "start"], ["key", "start", "ids_crc32"], "rank")
    # Segments are sorted by (length, rank); one number finds both.
    first = np.searchsorted(segments["length"], np.arange(capacity + 2))
    kept = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            segment = np.zeros(len(size), np.int64)
            for one in np.unique(size):
                at = size == one
                a, b = first[one], first[one + 1]
                segment[at] = a + np.searchsorted(segments["rank"][a:b], rank[at], side="right") - 1
            nth = rank - segments["rank"][segment]
            copies = segments["copies"][segment]
            columns = {name: batch.column(name) for name in kept}
            columns["sequence_id"] = pa.array(segments["sequence"][segment] + nth // copies)
            columns["offset"] = pa.array(segments["offset"][segment] + nth % copies * size)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kinds = ", ".join(f"{name} {kind}" for name, kind in pieces.dtypes)
    return ranked.select(*kept, "rank").mapInArrow(
        place, f"{kinds}, sequence_id bigint, offset bigint"
    )


def pack_documents(
    documents: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
) -> DataFrame:
    """One row per piece of a document, with its place: which sequence, and where in it.

    A document is its ids and then id 0; null and empty texts are that one id. It is cut into
    sequences of ``length`` ids and a rest, so the pieces do not depend on the other documents, and
    texts are read once. A third of all pieces may have one length: ranks are salted, and only the
    histogram reaches the driver. Null keys and repeated rows are packed like others. Other columns
    are not read.
    """
    scratch = Scratch(documents.sparkSession)
    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    pieces = scratch.store(rows.mapInArrow(piece_maker(tokenizer, length), PIECE_SCHEMA), "pieces")
    return place_pieces(pieces, length).withColumnRenamed("key", key)
