"""SimHash near-duplicates through an inverted index on positional bytes with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch, partitions
from foretoken.llm.components import connected_components

BYTES = 8
SEED = 42
# Distinct fingerprints from which a posting is keyed by four bytes rather than three.
WIDE_KEYS = 1 << 26
# Fingerprints of one posting that are compared in one place; a longer posting is cut in blocks.
BLOCK = 1 << 13
# Postings up to this length are compared pair by pair, longer ones by growing a spanning forest.
SHORT = 8


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(line[a:b], seed)
            for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
        ),
        np.uint64,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = 4, text: str = "text") -> DataFrame:
    """Add ``fp``, the fingerprint's 64 bits as a BIGINT."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return documents.withColumn("fp", of(F.col(text)))


def byte_sets(width: int, least: int = 4) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions, one of which lies in any ``least`` positions.

    Two fingerprints that share ``least`` positional bytes therefore share one posting. For three
    of four, positions fall into three groups and a set lies in one group, or has two positions in
    a group and one in the next: 20 sets rather than 56.
    """
    if width == least:
        return list(combinations(range(BYTES), least))
    if (width, least) != (3, 4):
        raise ValueError("sets of three positions cover four shared ones")
    group = [i % 3 for i in range(BYTES)]
    chosen = []
    for trio in combinations(range(BYTES), 3):
        counts = [sum(group[i] == g for i in trio) for g in range(3)]
        if 3 in counts or any(counts[g] == 2 and counts[(g + 1) % 3] == 1 for g in range(3)):
            chosen.append(trio)
    return chosen


def _close(one: np.ndarray, other: np.ndarray, bits: int) -> np.ndarray:
    """Count filter, then verification: enough equal positional bytes, then few different bits."""
    differ = one ^ other
    unequal = np.zeros(differ.shape, np.uint8)
    for i in range(BYTES):
        unequal += (differ >> np.uint64(8 * i)) & np.uint64(255) != 0
    return (unequal <= bits) & (np.bitwise_count(differ) <= bits)


def _forest(fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one posting: at most one per fingerprint."""
    left = fps
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            seed = frontier.pop()
            near = _close(left, seed, bits)
            if near.any():
                found, left = left[near], left[~near]
                yield np.full(len(found), seed, np.uint64), found
                frontier.extend(found)


def posting_links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the postings of a sorted run of keys."""
    left, right = [], []
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    rest = np.repeat(starts + sizes, sizes)
    short = np.repeat(sizes <= SHORT, sizes)
    at = np.arange(len(keys))
    for step in range(1, SHORT):
        one = at[short & (at + step < rest)]
        if not len(one):
            break
        one = one[_close(fps[one], fps[one + step], bits)]
        left.append(fps[one])
        right.append(fps[one + step])
    for k in np.flatnonzero(sizes > SHORT):
        for a, b in _forest(fps[starts[k] : starts[k] + sizes[k]], bits):
            left.append(a)
            right.append(b)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def near_links(distinct: DataFrame, bits: int = 4, width: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that join all distinct ``fp`` differing in at most ``bits`` <= 4 bits.

    With four different bits at least four of the eight bytes are equal, so a pair meets in a
    posting keyed by three of them (see ``byte_sets``), where its shared positional bytes are
    tallied, pairs below four are dropped and the others verified. Single bytes as keys would hold
    1/256 of all fingerprints each. A posting yields links that span its components, not all pairs.
    """
    if not 0 <= bits <= 4:
        raise ValueError("bits must lie in 0..4")
    spark = distinct.sparkSession
    if width is None:
        width = 3 if distinct.count() < WIDE_KEYS else 4
    sets = byte_sets(width)

    def byte(i):
        return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255)

    keys = [
        F.xxhash64(F.lit(k), *[byte(i) for i in chosen])
        if width > 3
        else F.lit(k << 24) + byte(chosen[0]) * 65536 + byte(chosen[1]) * 256 + byte(chosen[2])
        for k, chosen in enumerate(sets)
    ]
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    # Postings of over BLOCK fingerprints: every two of their blocks meet in a cell of their own.
    long = (
        postings.groupBy("key").count().where(F.col("count") > BLOCK)
        .select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = (
        postings.join(long, "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.when(F.col("blocks") == 1, F.col("key"))
            .otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
            .alias("cell"),
            "fp",
        )
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

        def made(keys, fps):
            a, b = posting_links(keys, fps, bits)
            pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"]
            )

        for batch in batches:
            keys = np.concatenate([held[0], batch.column(0).to_numpy()])
            fps = np.concatenate([held[1], batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1]))
            held = (keys[cut:], fps[cut:])
            yield made(keys[:cut], fps[:cut])
        yield made(*held)

    dealt = cells.repartition(partitions(spark), "cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(link, "a bigint, b bigint")


def simhash_components(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4
) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row of ``documents``.

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer than ``shingle``
    words is one shingle; null, empty and blank texts have fingerprint zero and link like any
    other. ``component_id`` is the smallest key that links reach; null keys are passed over, and a
    component with no other key has null. Repeated rows and keys each give a row. Other columns are
    not read.
    """
    scratch = Scratch(documents.sparkSession)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = scratch.store(fingerprints(rows, shingle).select("key", "fp"), "fingerprints")
    classes = scratch.store(marked.groupBy("fp").agg(F.min("key").alias("least")), "classes")
    links = near_links(classes.select("fp"), bits)
    parts = connected_components(links, scratch)
    rooted = scratch.store(
        classes.join(parts, classes["fp"] == parts["node"], "left").select(
            "fp", "least", F.coalesce("component", "fp").alias("root")
        ),
        "roots",
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(named, marked["fp"] == named["_fp"]).select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4
) -> DataFrame:
    """The rows of ``documents`` with one left of each near-duplicate group: that of the smallest key.

    Null keys come after all others; of rows with the same key one stays. All columns are kept.
    """
    scratch = Scratch(documents.sparkSession)
    # Rows are numbered once and stored, so that equal rows can be told apart.
    rows = scratch.store(
        documents.select(
            F.monotonically_increasing_id().alias("row"), F.struct("*").alias("document")
        ),
        "rows",
    )
    own = F.col(f"document.`{key}`")
    named = simhash_components(
        rows.select(
            F.struct(own.isNull().alias("none"), own.alias("own"), F.col("row")).alias("key"),
            F.col(f"document.`{text}`").alias("text"),
        ),
        "key",
        "text",
        shingle,
        bits,
    )
    kept = named.where(F.col("key") == F.col("component_id")).select(F.col("key.row").alias("kept"))
    return rows.join(kept, F.col("row") == F.col("kept"), "left_semi").select("document.*")
