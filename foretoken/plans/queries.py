"""The registered queries: each takes a session and a folder of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretoken.functions.text import split_tokens
from foretoken.operators import control, encoding, ngrams, packing, prefixes, scan, scoring
from foretoken.operators.vocabulary import token_counts, vocabulary
from foretoken.plans.pipeline import Pipeline, published
from foretoken.settings import Settings
from foretoken.sources import documents as docs
from foretoken.sources import samples as rows
from foretoken.sources import tables
from foretoken.streaming import counts as stream_counts
from foretoken.streaming import packing as stream_packing

# Rows, shards and limits that suit the given tables.
SMALL = Settings(
    row_length=128,
    n_shards=4,
    batch_size=256,
    seq_len=1,
    min_trigram_count=20,
)
# Ids of the short contexts of the scan at its full width.
WIDE_SEQ_LEN = 4
SLICES = ["de", "en", "es", "fr"]

_pipelines: dict[tuple, Pipeline] = {}


def _state_of(spark: SparkSession, path: str) -> tuple:
    """Changes whenever the files of a table do."""
    seen = spark.read.parquet(path).agg(
        F.count("*"),
        F.max("_metadata.file_modification_time"),
        F.max("_metadata.file_size"),
    )
    return tuple(seen.first())


def pipeline(spark: SparkSession, sf_dir: str, table: str = "documents") -> Pipeline:
    """The tables of one corpus, shared by all queries of a session while its files are the same."""
    path = f"{sf_dir}/{table}.parquet"
    key = (spark.sparkContext.applicationId, path, _state_of(spark, path))
    if key not in _pipelines:
        if table == "conversations":
            source = docs.read_conversations(spark, path, SMALL.n_shards)
        else:
            source = docs.read_documents(spark, path, SMALL.n_shards, ("lang",))
        _pipelines[key] = Pipeline(spark, source, SMALL)
    return _pipelines[key]


def _spaced(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def _listed(table: DataFrame) -> DataFrame:
    """Arrays of ids as text, so that results compare as plain values."""
    return table.select(
        *[
            _spaced(f.name).alias(f.name) if f.dataType.typeName() == "array" else f.name
            for f in table.schema.fields
        ]
    )


def _rounded(table: DataFrame) -> DataFrame:
    """Floats to 6 digits."""
    return table.select(
        *[
            (F.floor(F.col(f.name) * 1e6 + 0.5) / 1e6).alias(f.name)
            if f.dataType.typeName() == "double"
            else f.name
            for f in table.schema.fields
        ]
    )


def _counts(p: Pipeline, n: int) -> DataFrame:
    return p.ngrams(n).drop("id0_chunk")


def documents_by_shard(spark, sf):
    return docs.shard_row_counts(
        docs.read_documents(spark, f"{sf}/documents.parquet", SMALL.n_shards, spread=False)
    )


def shard_range(spark, sf):
    source = docs.read_documents(spark, f"{sf}/documents.parquet", SMALL.n_shards, spread=False)
    return docs.shard_range(source, SMALL.n_shards, 1, 3)


def token_counts_query(spark, sf):
    return token_counts(docs.read_documents(spark, f"{sf}/documents.parquet", SMALL.n_shards))


def document_lengths(spark, sf):
    source = docs.read_documents(spark, f"{sf}/documents.parquet", SMALL.n_shards)
    return source.select("doc_id", F.size(split_tokens(F.col("text"))).alias("n_tokens"))


def vocabulary_query(spark, sf):
    return vocabulary(token_counts_query(spark, sf), SMALL.vocab_size)


def encoded_documents(spark, sf):
    p = pipeline(spark, sf)
    return _listed(encoding.encode_documents(p.documents.drop("lang"), p.tokens()))


def pack_wrap(spark, sf):
    return _listed(packing.pack_wrap(pipeline(spark, sf).encoded(), SMALL.row_length))


def pack_nowrap(spark, sf):
    return _listed(packing.pack_nowrap(pipeline(spark, sf).encoded(), SMALL.row_length))


def samples_roundtrip(spark, sf):
    p = pipeline(spark, sf)
    path = _new_path(p, "samples_roundtrip")
    rows.write_samples(packing.pack_wrap(p.encoded(), SMALL.row_length), path)
    return _listed(rows.read_samples(spark, path))


def samples_capped(spark, sf):
    return _listed(rows.cap_per_shard(pipeline(spark, sf).samples(), 100))


def batch_cap(spark, sf):
    capped = rows.cap_batches(pipeline(spark, sf).samples(), SMALL.batch_size, 2)
    return _listed(capped)


def decode_samples(spark, sf):
    p = pipeline(spark, sf)
    return encoding.decode_rows(p.samples(), p.tokens()).drop("tokens")


def decoded_documents(spark, sf):
    """The text of every document, from its ids."""
    p = pipeline(spark, sf)
    inner = p.encoded().select("doc_id", F.slice("ids", F.lit(2), F.col("n") - 2).alias("ids"))
    return encoding.decode_rows(inner, p.tokens(), "ids").drop("ids")


def id_range_check(spark, sf):
    return encoding.id_range(pipeline(spark, sf).samples())


def ngrams_exploded(spark, sf):
    return ngrams.ngrams(pipeline(spark, sf).samples(), 2, ["shard", "sample"])


def ngram_partials(spark, sf):
    p = pipeline(spark, sf)
    return ngrams.ngram_partials(p.spread_samples(), 2, SMALL.batch_size, SMALL.id_chunks)


def ngram_recombine(spark, sf):
    p = pipeline(spark, sf)
    path = _new_path(p, "partials_3")
    p.write_partials(3, path)
    return ngrams.recombine(tables.read_partials(spark, path), 3)


def chunk_sizes(spark, sf):
    return ngrams.chunk_sizes(_counts(pipeline(spark, sf), 2), SMALL.id_chunks)


def chunk_scan(spark, sf):
    p = pipeline(spark, sf)
    p.ngrams(3)
    return tables.read_chunks(spark, p.rows_path("ngrams_3"), 7)


def union_chunks(spark, sf):
    return pipeline(spark, sf).ngrams(3)


def _ngram_query(n: int):
    return lambda spark, sf: ngrams.ngram_counts(pipeline(spark, sf).spread_samples(), n)


def _prefix_query(n: int):
    return lambda spark, sf: prefixes.next_token_prefixes(_counts(pipeline(spark, sf), n))


def _top_query(n: int):
    def query(spark, sf):
        p = pipeline(spark, sf)
        minimum = None if n == 2 else SMALL.min_trigram_count
        kept = prefixes.predictive(p.prefixes(n), SMALL.min_fraction, minimum)
        return prefixes.by_fraction(prefixes.add_tokens(kept, p.tokens()))

    return query


def top_trigrams_by_count(spark, sf):
    p = pipeline(spark, sf)
    return tables.write_ranked(prefixes.by_count(p.top(3)), _new_path(p, "top_trigrams_by_count"))


def token_lookup_misses(spark, sf):
    p = pipeline(spark, sf)
    return prefixes.lookup_misses(_counts(p, 3), p.tokens())


def _rank_query(n: int):
    def query(spark, sf):
        table = pipeline(spark, sf).prefixes(n)
        ranked = prefixes.rank_in_chunk(ngrams.with_chunk(table, SMALL.id_chunks))
        return ranked.select("id0_chunk", *[f"id{k}" for k in range(n - 1)], "rank")

    return query


def _score_query(n: int):
    def query(spark, sf):
        p = pipeline(spark, sf)
        return _rounded(scoring.score_by_slice(p.top(n), p.encoded(), "lang", SLICES))

    return query


def scan_windows(spark, sf):
    """The windows of one shard: a filter on the folder that is read."""
    first = pipeline(spark, sf).samples().where("shard = 0")
    return _listed(scan.paired_windows(first, SMALL.seq_len))


def next_token_dist(spark, sf):
    p = pipeline(spark, sf)
    dist = scan.next_token_distribution(_counts(p, 2), _counts(p, 3), SMALL.backoff)
    return _rounded(dist.select("id0", "id1", "id2", "p_short", "p_long", "n_context"))


def scan_metrics(spark, sf):
    return _rounded(pipeline(spark, sf).scan_metrics())


def scan_hits(spark, sf):
    return _rounded(scan.scan_hits(pipeline(spark, sf).scan_metrics()))


def scan_examples(spark, sf):
    p = pipeline(spark, sf)
    found = scan.scan_examples(
        p.samples(), p.scan_hits(), p.tokens(), SMALL.scan_batch_size, SMALL.context_ids
    )
    return _rounded(_listed(found))


def scan_filter(spark, sf):
    return _rounded(_listed(pipeline(spark, sf).scan_filter()))


def scan_metrics_wide(spark, sf):
    return _rounded(pipeline(spark, sf).scan_metrics(WIDE_SEQ_LEN))


def scan_filter_wide(spark, sf):
    return _rounded(_listed(pipeline(spark, sf).scan_filter(seq_len=WIDE_SEQ_LEN)))


def scan_top(spark, sf):
    p = pipeline(spark, sf)
    ranked = tables.write_ranked(scan.scan_top(p.scan_filter()), _new_path(p, "scan_top"))
    return _rounded(_listed(ranked))


def _interrupted_build(p: Pipeline) -> tuple[str, str]:
    """Token rows and manifest of a build that ends after the first half of its shards."""
    path = _new_path(p, "interrupted")
    control.build_pending_shards(
        p.encoded(),
        lambda part: packing.pack_wrap(part, SMALL.row_length),
        f"{path}/samples",
        f"{path}/manifest",
        SMALL.n_shards,
        shards_per_job=SMALL.n_shards // 2,
        jobs=1,
    )
    return f"{path}/samples", f"{path}/manifest"


def pending_shards(spark, sf):
    _, manifest = _interrupted_build(pipeline(spark, sf))
    return control.pending(
        control.all_shards(spark, SMALL.n_shards), control.read_manifest(spark, manifest)
    )


def shard_completeness(spark, sf):
    """Shards that have documents and, after an interrupted build, no rows."""
    p = pipeline(spark, sf)
    samples, _ = _interrupted_build(p)
    return control.missing(p.documents.select("shard").distinct(), rows.read_samples(spark, samples))


def _scored_query(n: int):
    return lambda spark, sf: _rounded(pipeline(spark, sf).scored(n, "lang", SLICES))


def export_all(spark, sf):
    """Rows of every published table, read back, and the sum of their counts where they have one."""
    p = pipeline(spark, sf)
    folder = _new_path(p, "export")
    sums = {"ngrams": "count", "prefixes": "sum_count", "top": "sum_count"}
    found = None
    for name, table in published(spark, folder, p.publish(folder)).items():
        column = sums.get(name.rsplit("_", 1)[0])
        total = F.sum(column) if column else F.lit(None)
        sizes = table.agg(
            F.lit(name).alias("name"), F.count("*").alias("n_rows"), total.cast("bigint").alias("total")
        )
        found = sizes if found is None else found.unionByName(sizes)
    return found


def export_roundtrip(spark, sf):
    p = pipeline(spark, sf)
    path = _new_path(p, "export_bigrams")
    tables.write_chunked(_counts(p, 2), path, SMALL.id_chunks)
    return tables.read_chunks(spark, path)


def _new_path(p: Pipeline, name: str) -> str:
    return p.path(f"{name}-{uuid.uuid4().hex}")


def stream_bigrams(spark, sf):
    """Token rows arrive two files at a time."""
    p = pipeline(spark, sf)
    p.samples()
    path = _new_path(p, "stream_bigrams")
    arriving = rows.read_sample_stream(spark, p.path("samples"), files_per_trigger=2)
    stream_counts.start_partial_counts(
        arriving, 2, f"{path}/partials", f"{path}/checkpoint", SMALL.id_chunks
    ).awaitTermination()
    return stream_counts.merge_partials(spark, f"{path}/partials", 2)


def stream_bigrams_tiered(spark, sf):
    """Token rows arrive file by file; counts are merged two runs at a time."""
    p = pipeline(spark, sf)
    p.samples()
    path = _new_path(p, "stream_bigrams_tiered")
    arriving = rows.read_sample_stream(spark, p.path("samples"), files_per_trigger=1)
    stream_counts.start_partial_counts(
        arriving, 2, f"{path}/partials", f"{path}/checkpoint", SMALL.id_chunks, fan=2
    ).awaitTermination()
    return stream_counts.merge_partials(spark, f"{path}/partials", 2)


def stream_pack(spark, sf):
    """Encoded documents arrive in four parts, in the order of their ids."""
    p = pipeline(spark, sf)
    path = _new_path(p, "stream_pack")
    ordered = p.encoded().select("shard", "doc_id", "ids", "n")
    cuts = sorted(set(ordered.approxQuantile("doc_id", [0.25, 0.5, 0.75], 0.01)))
    landing = f"{path}/landing"
    for part in range(len(cuts) + 1):
        arrived = F.lit(True)
        if part:
            arrived = arrived & (F.col("doc_id") >= cuts[part - 1])
        if part < len(cuts):
            arrived = arrived & (F.col("doc_id") < cuts[part])
        ordered.where(arrived).write.mode("append").parquet(landing)
        arriving = spark.readStream.schema(ordered.schema).parquet(landing)
        stream_packing.start_packing(
            arriving, f"{path}/packed", f"{path}/checkpoint", SMALL.row_length
        ).awaitTermination()
    return _listed(stream_packing.packed_rows(spark, f"{path}/packed"))


def conversation_bigrams(spark, sf):
    return ngrams.ngram_counts(pipeline(spark, sf, "conversations").spread_samples(), 2)


def conversation_top_bigrams(spark, sf):
    return pipeline(spark, sf, "conversations").top(2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "documents_by_shard": documents_by_shard,
    "shard_range": shard_range,
    "token_counts": token_counts_query,
    "document_lengths": document_lengths,
    "vocabulary": vocabulary_query,
    "encoded_documents": encoded_documents,
    "pack_wrap": pack_wrap,
    "pack_nowrap": pack_nowrap,
    "samples_roundtrip": samples_roundtrip,
    "samples_capped": samples_capped,
    "batch_cap": batch_cap,
    "decode_samples": decode_samples,
    "decoded_documents": decoded_documents,
    "id_range_check": id_range_check,
    "ngrams_exploded": ngrams_exploded,
    "ngram_partials": ngram_partials,
    "ngram_recombine": ngram_recombine,
    "chunk_sizes": chunk_sizes,
    "chunk_scan": chunk_scan,
    "union_chunks": union_chunks,
    "unigrams": _ngram_query(1),
    "bigrams": _ngram_query(2),
    "trigrams": _ngram_query(3),
    "fourgrams": _ngram_query(4),
    "bigram_prefixes": _prefix_query(2),
    "trigram_prefixes": _prefix_query(3),
    "top_bigrams": _top_query(2),
    "top_trigrams": _top_query(3),
    "top_trigrams_by_count": top_trigrams_by_count,
    "token_lookup_misses": token_lookup_misses,
    "prefix_rank_in_chunk": _rank_query(3),
    "fourgram_prefix_rank_in_chunk": _rank_query(4),
    "score_bigrams_by_slice": _score_query(2),
    "score_trigrams_by_slice": _score_query(3),
    "top_bigrams_scored": _scored_query(2),
    "top_trigrams_scored": _scored_query(3),
    "scan_windows": scan_windows,
    "next_token_dist": next_token_dist,
    "scan_metrics": scan_metrics,
    "scan_hits": scan_hits,
    "scan_examples": scan_examples,
    "scan_filter": scan_filter,
    "scan_metrics_wide": scan_metrics_wide,
    "scan_filter_wide": scan_filter_wide,
    "scan_top": scan_top,
    "pending_shards": pending_shards,
    "shard_completeness": shard_completeness,
    "export_roundtrip": export_roundtrip,
    "export_all": export_all,
    "stream_bigrams": stream_bigrams,
    "stream_bigrams_tiered": stream_bigrams_tiered,
    "stream_pack": stream_pack,
    "conversation_bigrams": conversation_bigrams,
    "conversation_top_bigrams": conversation_top_bigrams,
}
