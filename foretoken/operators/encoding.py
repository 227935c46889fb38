"""Token text to ids and back, without loss, by a table of at most 65,536 tokens."""

from __future__ import annotations

import codecs
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from foretoken.functions.text import split_tokens, with_boundaries
from foretoken.operators.vocabulary import byte_token
from foretoken.settings import FIRST_BYTE_ID, FIRST_TOKEN_ID, ID_SPAN

# Items of lists that a Python task looks at together: it holds several arrays of their number.
RUN_ITEMS = 1 << 20
# Bytes of text that a token table may have to go to every task.
TABLE_BYTES = 64 << 20


def _lookup_values(tokens: DataFrame) -> list[str]:
    """Token texts by id; at most 65,536 of them and ``TABLE_BYTES``, or an error."""
    n, top, size = tokens.agg(
        F.count("*"), F.max("id"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))
    ).first()
    if n > ID_SPAN or n != top + 1:
        raise ValueError("token ids must be dense, from 0, and fit 16 bits")
    if size > TABLE_BYTES:
        raise ValueError(f"{size} bytes of token texts are too many to hand to every task")
    return [row.token for row in tokens.orderBy("id").select("token").collect()]


def _swap_column(frame: DataFrame, name: str, new: StructField) -> StructType:
    return StructType([new if f.name == name else f for f in frame.schema.fields])


def _runs(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose lists in column ``at`` have ``RUN_ITEMS`` items, or one row."""
    offsets = batch.column(at).offsets.to_numpy()
    start = 0
    while start < len(batch):
        most = int(np.searchsorted(offsets, offsets[start] + RUN_ITEMS, side="right")) - 1
        stop = max(start + 1, most)
        yield batch.slice(start, stop - start)
        start = stop


def _spelled(tokens: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of tokens, one after the other, and how many each has: one, or one for each byte."""
    found = pc.index_in(tokens, value_set=known)
    unknown = found.is_null().to_numpy(zero_copy_only=False)
    counts = np.ones(len(tokens), np.int64)
    counts[unknown] = pc.binary_length(tokens.filter(pa.array(unknown))).to_numpy()
    starts = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), np.int32)
    ids[starts[~unknown]] = found.drop_null().to_numpy() + FIRST_TOKEN_ID
    spelled = "".join(tokens.filter(pa.array(unknown)).to_pylist()).encode()
    lengths = counts[unknown]
    inside = np.arange(len(spelled)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ids[np.repeat(starts[unknown], lengths) + inside] = (
        np.frombuffer(spelled, np.uint8).astype(np.int32) + FIRST_BYTE_ID
    )
    return ids, counts


def encode_documents(documents: DataFrame, tokens: DataFrame) -> DataFrame:
    """Replace ``text`` by ``ids`` (begin mark, token ids, end mark) and add their number ``n``.

    A token that the table does not have is spelled in the ids of its UTF-8 bytes, so that ids
    always give the text back.
    """
    split = documents.withColumn("text", split_tokens(F.col("text")))
    known = _lookup_values(tokens)
    if known[FIRST_BYTE_ID:FIRST_TOKEN_ID] != [byte_token(b) for b in range(256)]:
        raise ValueError("the token table has no ids for single bytes")
    shared = documents.sparkSession.sparkContext.broadcast(known[FIRST_TOKEN_ID:])
    at = split.columns.index("text")
    schema = _swap_column(split, "text", StructField("ids", ArrayType(IntegerType())))
    names = schema.fieldNames()

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.string())
        for batch in (run for batch in batches for run in _runs(batch, at)):
            lists = batch.column(at)
            ids, counts = _spelled(lists.flatten(), table)
            ends = np.concatenate([[0], np.cumsum(counts)])
            offsets = lists.offsets.to_numpy()
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(
                pa.array(ends[offsets - offsets[0]], pa.int32()), pa.array(ids, pa.int32())
            )
            yield pa.RecordBatch.from_arrays(columns, names=names)

    keep = [c for c in documents.columns if c != "text"]
    ids = split.mapInArrow(look_up, schema)
    return ids.select(*keep, with_boundaries(F.col("ids")).alias("ids")).withColumn(
        "n", F.size("ids")
    )


def encode_with(
    documents: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], list[list[int]]]],
    begin: Sequence[int],
    end: Sequence[int],
) -> DataFrame:
    """:func:`encode_documents` with a tokenizer of the caller's.

    ``make_encoder`` is called once per task and returns a function from texts to their ids;
    ``begin`` and ``end`` are the ids that mark a document's ends.
    """
    own = [int(i) for i in make_encoder()([""])[0]]
    for name, mark in (("begin", begin), ("end", end)):
        if len(mark) > 1:
            warnings.warn(f"the {name} mark is {len(mark)} ids, not one", stacklevel=2)
        if mark and any(own[i : i + len(mark)] == list(mark) for i in range(len(own))):
            warnings.warn(f"the tokenizer adds the {name} mark by itself", stacklevel=2)
    at = documents.columns.index("text")
    schema = _swap_column(documents, "text", StructField("ids", ArrayType(IntegerType())))
    names = schema.fieldNames()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            texts = [text or "" for text in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(encoder(texts), pa.list_(pa.int32()))
            limits = pc.min_max(columns[at].flatten())
            low, high = limits["min"].as_py(), limits["max"].as_py()
            if low is not None and not 0 <= low <= high < ID_SPAN:
                raise ValueError(f"ids from {low} to {high} do not fit 16 bits")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    keep = [c for c in documents.columns if c != "text"]
    ids = documents.mapInArrow(encode, schema)
    return ids.select(*keep, with_boundaries(F.col("ids"), begin, end).alias("ids")).withColumn(
        "n", F.size("ids")
    )


def token_table(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """``(id, token)`` of a tokenizer of the caller's, from the text of every id in order."""
    if len(texts) > ID_SPAN:
        raise ValueError(f"{len(texts)} tokens do not fit 16 bits")
    return spark.createDataFrame(list(enumerate(texts)), "id int, token string")


def _bytes_shown(error: UnicodeDecodeError) -> tuple[str, int]:
    return "".join(map(byte_token, error.object[error.start : error.end])), error.end


def decode_rows(
    rows: DataFrame, tokens: DataFrame, ids: str = "tokens", out: str = "text"
) -> DataFrame:
    """Add the text of an array of ids; an id without a token is an error.

    Byte ids next to each other are read as UTF-8. Where a row cuts through a character, the bytes
    that it has of it are written as they are named in the token table.
    """
    known = _lookup_values(tokens)
    spells = known[FIRST_BYTE_ID:FIRST_TOKEN_ID] == [byte_token(b) for b in range(256)]
    shared = rows.sparkSession.sparkContext.broadcast(known)
    at = rows.columns.index(ids)
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])
    names = schema.fieldNames()

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.string())
        if spells:
            codecs.register_error("bytes-shown", _bytes_shown)
            raw = [
                bytes([i - FIRST_BYTE_ID]) if FIRST_BYTE_ID <= i < FIRST_TOKEN_ID else token.encode()
                for i, token in enumerate(shared.value)
            ]
        for batch in (run for batch in batches for run in _runs(batch, at)):
            lists = batch.column(at)
            flat = lists.flatten()
            words = pa.ListArray.from_arrays(
                pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32()),
                table.take(flat),
            )
            text = pc.binary_join(words, "")
            numbers = flat.to_numpy()
            if spells and ((numbers >= FIRST_BYTE_ID) & (numbers < FIRST_TOKEN_ID)).any():
                text = pa.array(
                    [
                        b"".join(map(raw.__getitem__, row or ())).decode("utf-8", "bytes-shown")
                        for row in lists.to_pylist()
                    ],
                    pa.string(),
                )
            text = pc.if_else(lists.is_null(), None, text)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=names)

    return rows.mapInArrow(look_up, schema)


def id_range(rows: DataFrame, ids: str = "tokens") -> DataFrame:
    """Per shard: how many ids there are, their range, and how many 16 unsigned bits cannot hold."""
    outside = (F.col("id") < 0) | (F.col("id") >= ID_SPAN)
    return (
        rows.select("shard", F.explode(ids).alias("id"))
        .groupBy("shard")
        .agg(
            F.count("*").alias("n_ids"),
            F.min("id").alias("min_id"),
            F.max("id").alias("max_id"),
            F.count_if(outside).alias("n_outside"),
        )
    )
