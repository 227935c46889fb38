"""The jobs from documents to published tables, with each shared result written once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretoken.operators import scan
from foretoken.operators.control import (
    FINISHED,
    build_changed_shards,
    mark_finished,
    read_manifest,
    reads_files,
    require_complete,
    shard_states,
)
from foretoken.operators.encoding import encode_documents, encode_with, token_table
from foretoken.operators.ngrams import ngram_counts, ngram_partials
from foretoken.operators.packing import pack_nowrap, pack_wrap
from foretoken.operators.prefixes import add_tokens, by_count, by_fraction, next_token_prefixes, predictive
from foretoken.operators.scoring import score_by_model, score_by_slice
from foretoken.operators.vocabulary import token_counts, vocabulary
from foretoken.session import remove_folder, shared_folder
from foretoken.settings import Settings
from foretoken.sources.documents import shard_range
from foretoken.sources.samples import (
    batch_fits_a_task,
    cap_batches,
    cap_per_shard,
    gather_batches,
    read_samples,
    spread_samples,
)
from foretoken.sources.tables import (
    read_chunks,
    union_chunks,
    write_chunked,
    write_partials,
    write_ranked,
    write_table,
)
from foretoken.sources.versions import (
    live_number,
    live_path,
    live_state,
    new_folder,
    read_live,
    replace,
    switch,
)

# Folders that encoded documents may be spread over before all are encoded again.
MOST_PARTS = 8


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer of the caller's: how to make its encoder in a task, the text of every id, and the
    ids that mark a document's ends. ``name`` tells versions apart."""

    name: str
    make_encoder: Callable[[], Callable[[list[str]], list[list[int]]]]
    texts: Sequence[str]
    begin: Sequence[int]
    end: Sequence[int]


def _folders(state: dict) -> list[str]:
    return [part["folder"] for part in state["parts"]]


def _hash(*parts: object) -> str:
    return hashlib.sha256("\n".join(map(str, parts)).encode()).hexdigest()


class Pipeline:
    """Tables of one corpus under one folder.

    ``documents`` is ``(shard, doc_id, text, *extra)``. Every table is computed when first asked
    for, written, and read back by whatever needs it next: a lost executor repeats one job's tasks
    and not the jobs before it. Tables other than token rows are replaced in one step, so that a
    reader never finds one half written. In a folder of the caller's, tables that an earlier run finished
    with the same settings, tokenizer and documents are used as they are. Where only documents have
    changed, encoded documents and token rows are built again for the shards whose files have, or for
    all if the token table is another; token rows go on at the shards that an earlier run left.
    Anything else is built again.
    """

    def __init__(
        self,
        spark: SparkSession,
        documents: DataFrame,
        settings: Settings | None = None,
        folder: str | None = None,
        wrap: bool = True,
        tokenizer: Tokenizer | None = None,
    ) -> None:
        self.spark = spark
        self.settings = settings or Settings()
        self.documents = shard_range(
            documents, self.settings.n_shards, self.settings.begin_shard, self.settings.end_shard
        )
        self.folder = folder or shared_folder(spark)
        self.wrap = wrap
        self.tokenizer = tokenizer
        self._written: set[str] = set()
        self._made_from = None
        self._states: dict[int, str] | None = None
        own = [self.settings, wrap, tokenizer and tokenizer.name]
        if reads_files(self.documents):
            own.append(self.documents._jdf.queryExecution().optimizedPlan().canonicalized().toString())
        self._setup = _hash(*own)
        if folder is not None:
            self._made_from = _hash(self._setup, sorted(self._shard_states().items()))
            # A handful of table names.
            done = read_manifest(spark, self.path("manifest"), "name STRING, made_from STRING")
            ours = done.where((F.col("status") == FINISHED) & (F.col("made_from") == self._made_from))
            self._written = {row.name for row in ours.collect()}
            others = done.where(F.col("made_from") != self._made_from).limit(1).collect()
            if others:
                # What other settings or documents left must not be taken for ours, now or later.
                # Encoded documents and token rows say themselves, by shard, what they were made from.
                self._written = set()
                remove_folder(spark, self.path("manifest"))

    def _shard_states(self) -> dict[int, str]:
        if self._states is None:
            self._states = shard_states(self.documents)
        return self._states

    def _shards_made_from(self) -> dict[int, str]:
        """What the ids of each shard are made from: settings, token table and source."""
        tokens = self.tokens()
        table = tokens.agg(F.count("*"), F.bit_xor(F.xxhash64(*tokens.columns))).first()
        return {s: _hash(self._setup, tuple(table), state) for s, state in self._shard_states().items()}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def rows_path(self, name: str) -> str:
        """The folder that holds the rows of a finished table now."""
        return live_path(self.spark, self.path(name))

    def _mark(self, name: str) -> None:
        if self._made_from is not None:
            mark_finished(
                self.spark,
                self.path("manifest"),
                [(name, self._made_from)],
                "name STRING, made_from STRING",
            )

    def _once(self, name: str, write: Callable[[str], object]) -> str:
        path = self.path(name)
        if name not in self._written:
            if not self._written:
                self._mark("")  # from here on the folder holds tables of ours
            write(path)
            self._written.add(name)
            self._mark(name)
        return path

    def _table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return read_live(self.spark, self._replaced(name, lambda path: write_table(build(), path)))

    def _replaced(self, name: str, write: Callable[[str], object]) -> str:
        return self._once(name, lambda path: replace(self.spark, path, write))

    def tokens(self) -> DataFrame:
        # At most 65,536 rows: one file.
        def build():
            if self.tokenizer:
                return token_table(self.spark, self.tokenizer.texts).coalesce(1)
            return vocabulary(token_counts(self.documents), self.settings.vocab_size).coalesce(1)

        return self._table("tokens", build)

    def encoded(self) -> DataFrame:
        """Encoded documents: the parts written by this and earlier runs, each for its shards."""

        def encode(documents: DataFrame) -> DataFrame:
            if self.tokenizer:
                own = self.tokenizer
                return encode_with(documents, own.make_encoder, own.begin, own.end)
            return encode_documents(documents, self.tokens())

        def write(path: str) -> None:
            seen = live_number(self.spark, path)
            state = live_state(self.spark, path, seen) or {"made_from": {}, "parts": []}
            made_from = {str(s): made for s, made in self._shards_made_from().items()}
            same = {int(s) for s, made in made_from.items() if state["made_from"].get(s) == made}
            parts = [
                {"folder": part["folder"], "shards": sorted(same & set(part["shards"]))}
                for part in state["parts"]
            ]
            parts = [part for part in parts if part["shards"]]
            if len(parts) >= MOST_PARTS:
                parts, same = [], set()
            left = sorted(int(s) for s in made_from if int(s) not in same)
            if left or not parts:
                documents = self.documents
                if parts:
                    documents = documents.where(F.col("shard").isin(left))
                folder = new_folder()
                write_table(encode(documents), f"{path}/{folder}")
                parts.append({"folder": folder, "shards": left})
            switch(self.spark, path, seen, {"made_from": made_from, "parts": parts}, _folders)

        path = self._once("encoded", write)
        parts = [
            (self.spark.read.parquet(f"{path}/{part['folder']}"), part["shards"])
            for part in live_state(self.spark, path)["parts"]
        ]
        if len(parts) == 1 and parts[0][1] == sorted(self._shard_states()):
            return parts[0][0]
        chosen = [table.where(F.col("shard").isin(shards)) for table, shards in parts]
        return union_chunks(chosen)

    def samples(self) -> DataFrame:
        """Token rows, built shard by shard where an earlier run stopped; none may be missing."""

        def build(path: str) -> None:
            length = self.settings.row_length
            pack = pack_wrap if self.wrap else pack_nowrap
            encoded = self.encoded()
            build_changed_shards(
                encoded,
                lambda part: cap_per_shard(pack(part, length), self.settings.n_samples_per_shard),
                path,
                self.path("samples_manifest"),
                self._shards_made_from(),
                self.settings.shards_per_job,
            )
            full = encoded.groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") >= length)
            require_complete(full.select("shard"), read_samples(self.spark, path))

        return read_samples(self.spark, self._once("samples", build))

    def spread_samples(self) -> DataFrame:
        """Token rows for counting, in tasks of a bounded number of ids."""
        return spread_samples(self.samples(), self.settings.row_length)

    def write_partials(self, n: int, path: str) -> None:
        """Counts of n-grams for every batch of token rows, in one folder each."""
        s = self.settings
        gathered = batch_fits_a_task(s.row_length, s.batch_size, s.n_shards)
        rows = (
            gather_batches(self.samples(), s.row_length, s.batch_size)
            if gathered
            else self.spread_samples()
        )
        write_partials(ngram_partials(rows, n, s.batch_size, s.id_chunks), path, gathered)

    def _counted_rows(self) -> DataFrame:
        limit = self.settings.batches
        rows = cap_batches(self.samples(), self.settings.batch_size, limit).drop("batch")
        return spread_samples(rows, self.settings.row_length)

    def ngrams(self, n: int) -> DataFrame:
        path = self._replaced(
            f"ngrams_{n}",
            lambda path: write_chunked(
                ngram_counts(self._counted_rows(), n), path, self.settings.id_chunks
            ),
        )
        return read_chunks(self.spark, live_path(self.spark, path))

    def prefixes(self, n: int) -> DataFrame:
        """Most common next token after ``n - 1`` ids."""
        path = self._replaced(
            f"prefixes_{n}",
            lambda path: write_chunked(
                next_token_prefixes(self.ngrams(n).drop("id0_chunk")),
                path,
                self.settings.id_chunks,
                [F.desc("frac_max")],
            ),
        )
        return read_chunks(self.spark, live_path(self.spark, path)).drop("id0_chunk")

    def top(self, n: int) -> DataFrame:
        """Prefixes that almost settle their next token, with text."""
        minimum = None if n == 2 else self.settings.min_trigram_count
        return self._table(
            f"top_{n}",
            lambda: by_fraction(
                add_tokens(
                    predictive(self.prefixes(n), self.settings.min_fraction, minimum),
                    self.tokens(),
                )
            ),
        )

    def scored(
        self,
        n: int,
        slice_column: str | None = None,
        slices: Sequence[str] = (),
        models: dict[str, Callable] | None = None,
        profile: ResourceProfile | None = None,
    ) -> DataFrame:
        """Published prefixes by falling ``sum_count``, their place as ``rank``, with a probability
        of the last token under each slice of the corpus and each model of the caller's."""

        def write(path: str) -> None:
            table = self.top(n)
            if slice_column:
                table = score_by_slice(table, self.encoded(), slice_column, list(slices))
            if models:
                table = score_by_model(table, models, profile=profile)
            ranked = write_ranked(by_count(table), f"{path}_sorted")
            write_table(ranked, path)
            remove_folder(self.spark, f"{path}_sorted")

        told = "_".join([f"top_{n}_p", *([slice_column, *slices] if slice_column else []), *(models or {})])
        return read_live(self.spark, self._replaced(told, write))

    def scan_metrics(self, seq_len: int | None = None) -> DataFrame:
        length = seq_len or self.settings.seq_len
        return scan.scan_metrics(
            self.ngrams(length + 1).drop("id0_chunk"),
            self.ngrams(length + 2).drop("id0_chunk"),
            self.settings.backoff,
        )

    def scan_hits(self, seq_len: int | None = None) -> DataFrame:
        length = seq_len or self.settings.seq_len
        return self._table(f"scan_hits_{length}", lambda: scan.scan_hits(self.scan_metrics(length)))

    def scan_filter(self, samples: DataFrame | None = None, seq_len: int | None = None) -> DataFrame:
        """Published scan result over all rows, for short contexts of ``seq_len`` ids or of the
        settings'. That over other ``samples`` is not kept."""
        length = seq_len or self.settings.seq_len

        def found(rows: DataFrame) -> DataFrame:
            return scan.scan_filter(
                rows,
                self.scan_hits(length),
                self.tokens(),
                self.settings.scan_batch_size,
                self.settings.context_ids,
            )

        if samples is not None:
            return scan.scan_top(found(samples))
        return self._table(
            f"scan_filter_{length}", lambda: scan.scan_top(found(self._counted_rows()))
        )

    def export(self, folder: str, widths: Sequence[int] = (2, 3)) -> list[str]:
        """Write all tables for publishing: n-grams, prefixes and published prefixes in folders by
        chunk of their first id, tokens and the scan as they are. Returns the tables' names."""
        names = []
        for n in widths:
            chunked = {
                f"ngrams_{n}": self.ngrams(n).drop("id0_chunk"),
                f"prefixes_{n}": self.prefixes(n),
                f"top_{n}": self.top(n),
            }
            for name, table in chunked.items():
                write_chunked(table, f"{folder}/{name}", self.settings.id_chunks)
                names.append(name)
        for name, table in (("tokens", self.tokens()), ("scan_filter", self.scan_filter())):
            write_table(table, f"{folder}/{name}")
            names.append(name)
        return names

    def publish(self, folder: str, widths: Sequence[int] = (2, 3)) -> list[str]:
        """Replace all tables of an earlier publication in one step; :func:`published` reads them.
        Whoever reads finds tables of one and the same publication."""
        names: list[str] = []
        replace(self.spark, folder, lambda new: names.extend(self.export(new, widths)))
        return names


def published(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of the newest publication in ``folder``."""
    now = live_path(spark, folder)
    return {name: spark.read.parquet(f"{now}/{name}") for name in names}
