"""Phrases of up to four words whose parts mostly occur together, from a weighted de Bruijn graph.

Nodes are runs of three words, edges the runs of four that lead from one node to the next. Every
place of a text gives one row, the longest run that starts there: an edge, or a shorter run where the
piece ends. Counts of shorter runs are not counted again: what flows out of a node over its edges,
and what ends in it, is the count of the node, and so on down to single words.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch

WORDS = 4
LEAST = 30
TOP = 2000
UNKNOWN_LANGUAGE = "und"
# Bytes of text whose runs are added up before they are sent.
CHUNK_BYTES = 6 << 20
# Turns in which they are added up, each with other parts of the key space: a sort needs several
# times the memory of its runs.
TURNS = 8
# Bytes of text for each part of the key space; a part is added up in one place, and one with more
# rows than SPLIT_ROWS is dealt out further.
PART_BYTES = 8 << 20
SPLIT_ROWS = 1 << 22
# Links of one path that are put together in one row.
PATH_ROWS = 1 << 10

# White space inside a piece, and what ends a piece.
TO_BLANK, TO_END = "\t", ".,;:!?\n\x0b\x0c\r"
SEPARATORS = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + (TO_BLANK + TO_END).encode(),
    b"abcdefghijklmnopqrstuvwxyz" + b" " * len(TO_BLANK) + b"\n" * len(TO_END),
)


def _words(buffer: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a buffer in which blanks and line ends part them, and where each begins."""
    inside = np.concatenate([[False], (buffer != 32) & (buffer != 10), [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[0::2], turns[1::2]
    # Cut out in one go: each word ends where the next begins once the separators are gone.
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    kept = buffer[inside[1:-1]]
    return (
        pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]
        ),
        starts,
    )


class Runs:
    """Distinct runs of words with counts: a language and up to four words as codes, 0 for none."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, names: list[bytes]) -> None:
        # names[0] stands for no word.
        self.codes, self.counts, self.names = codes, counts, names

    def _summed(self, starts: np.ndarray, columns: int) -> Runs:
        counts = np.add.reduceat(self.counts, starts) if len(starts) else self.counts
        return Runs(self.codes[starts, :columns], counts, self.names)

    def added_up(self) -> Runs:
        """Equal runs once, in the order of their codes."""
        key, span = np.zeros(len(self.codes), np.int64), 1
        for k in range(self.codes.shape[1]):
            if span * len(self.names) > 1 << 62:
                found, key = np.unique(key, return_inverse=True)
                span = len(found)
            key, span = key * len(self.names) + self.codes[:, k], span * len(self.names)
        order = np.argsort(key)
        key = key[order]
        sorted_runs = Runs(self.codes[order], self.counts[order], self.names)
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        return sorted_runs._summed(starts, self.codes.shape[1])

    def where(self, chosen: np.ndarray) -> Runs:
        return Runs(self.codes[chosen], self.counts[chosen], self.names)

    def sizes(self) -> np.ndarray:
        return (self.codes[:, 1:] != 0).sum(axis=1)

    def shortened(self) -> Runs:
        """Runs without the last of their words: what flows through the node where each begins.

        Runs are in the order of their codes, so that those that begin alike are neighbours.
        """
        columns = self.codes.shape[1] - 1
        differs = (self.codes[1:, :columns] != self.codes[:-1, :columns]).any(axis=1)
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(self.codes), 1), bool), differs]))
        return self._summed(starts, columns)

    def hashed_names(self) -> np.ndarray:
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.names], np.uint64)
        own[0] = 0
        return own

    def hashed(self, columns: int, own: np.ndarray | None = None) -> np.ndarray:
        """A number below 2**63 from the language and the first words of each run; ``own``: hashes
        of the names, if they are known."""
        own = self.hashed_names() if own is None else own
        key = np.zeros(len(self.codes), np.uint64)
        for k in range(columns):
            key = (key ^ own[self.codes[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return (key >> np.uint64(1)).astype(np.int64)

    def rows(self, part: np.ndarray) -> pa.RecordBatch:
        """Rows to ship, one for each value of ``part``: its words, and its runs as codes of them."""
        if not len(self.codes):
            return pa.RecordBatch.from_pylist([], schema=RUNS)
        # Runs stay in their order inside a part: neighbours that begin alike compress well.
        order = np.argsort(part, kind="stable")
        part, codes, counts = part[order], self.codes[order], self.counts[order]
        names = np.array(self.names, object)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = np.zeros(len(names), bool)
            here[codes[a:b]] = True
            here[0] = True
            own = (np.cumsum(here) - 1).astype(np.uint32)[codes[a:b]].T
            words = b"\n".join(names[here][1:].tolist())
            own = own.astype("<u2") if here.sum() < 1 << 16 else own
            out.append((int(part[a]), b - a, *map(_packed, (words, own.tobytes(), counts[a:b].astype("<i8").tobytes()))))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out), RUNS)], schema=RUNS
        )

    def phrases(self) -> pa.RecordBatch:
        """Runs as text, with their language."""
        langs = {code: unquote(self.names[code][1:].decode()) for code in np.unique(self.codes[:, 0]).tolist()}
        names = pa.array(self.names, pa.large_binary())
        spaced = pa.array([b"", *[b" " + w for w in self.names[1:]]], pa.large_binary())
        columns = [names.take(pa.array(self.codes[:, 1]))]
        columns += [spaced.take(pa.array(self.codes[:, k])) for k in range(2, self.codes.shape[1])]
        text = pc.binary_join_element_wise(*columns, pa.scalar(b"", pa.large_binary()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([langs[c] for c in self.codes[:, 0].tolist()], pa.string()),
                pa.array(self.sizes(), pa.int32()),
                text.cast(pa.binary()).cast(pa.string()),
                pa.array(self.counts, pa.int64()),
            ],
            ["lang", "size", "phrase", "f"],
        )


RUNS = pa.schema(
    [("part", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())]
)


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b""


def runs_of_texts(langs: list[str], texts: list[bytes], width: int = WORDS) -> Runs:
    """The longest run from every place of some texts, equal ones not added up yet; a language is a
    word with its name quoted."""
    buffer = np.frombuffer(b"\n".join([*[t.translate(SEPARATORS) for t in texts], b""]), np.uint8)
    words, starts = _words(buffer)
    coded = words.dictionary_encode()
    # Codes in the order of the words: neighbours in a list of words compress well.
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    codes, names = rank[coded.indices.to_numpy()], [b"", *coded.dictionary.take(pa.array(order)).to_pylist()]
    del words, coded
    piece = np.searchsorted(np.flatnonzero(buffer == 10), starts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    known = {name: len(names) + i for i, name in enumerate(dict.fromkeys(langs))}
    names += [b"=" + quote(name, safe="").encode() for name in known]
    language = np.array([known[name] for name in langs], np.int64)[np.searchsorted(ends, starts, "right")]
    n = len(codes)
    del buffer, starts
    table = np.zeros((n, width + 1), np.int32)
    table[:, 0] = language
    for k in range(min(width, n)):
        table[: n - k, k + 1] = np.where(piece[k:] == piece[: n - k], codes[k:], 0)
    return Runs(table, np.ones(n, np.int64), names)


def runs_of_rows(rows: pa.RecordBatch | pa.Table, width: int = WORDS) -> Runs:
    """The runs of several rows that were shipped, equal ones added up."""
    words, codes, counts, starts = [pa.array([], pa.large_binary())], [], [], [0]
    columns = [rows.column(c).to_pylist() for c in ("n", "words", "codes", "counts")]
    for n, own_words, own_codes, own_counts in zip(*columns):
        words.append(pa.array(_unpacked(own_words).split(b"\n"), pa.large_binary()))
        raw = _unpacked(own_codes)
        short = len(raw) == 2 * n * (width + 1)
        codes.append(np.frombuffer(raw, "<u2" if short else "<u4").reshape(width + 1, n).T)
        counts.append(np.frombuffer(_unpacked(own_counts), "<i8"))
        starts.append(starts[-1] + len(words[-1]))
    coded = pa.concat_arrays(words).dictionary_encode()
    to = coded.indices.to_numpy() + 1
    table = np.concatenate(
        [np.concatenate([[0], to[a:b]]).astype(np.int32)[c] for a, b, c in zip(starts[:-1], starts[1:], codes)]
    )
    return Runs(table, np.concatenate(counts), [b"", *coded.dictionary.to_pylist()]).added_up()


def _edge_maker(parts: int, chunk_bytes: int):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, texts, held = [], [], 0

        def made() -> Iterator[pa.RecordBatch]:
            runs = runs_of_texts(langs, texts)
            langs.clear()
            texts.clear()
            own = runs.hashed_names()
            # All runs that begin with the same two words go to one part, and so to one turn.
            turns = (runs.hashed(3, own) % parts % TURNS).astype(np.int8)
            for turn in range(TURNS):
                summed = runs.where(turns == turn).added_up()
                yield summed.rows(summed.hashed(3, own) % parts)
                del summed
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                langs.append(lang)
                texts.append(text.as_buffer().to_pybytes())
                held += len(texts[-1]) + 1
                if held >= chunk_bytes:
                    yield from made()
                    held = 0
        if texts:
            yield from made()

    return edges


def _splitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal the runs of large parts out by their third word."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            runs = runs_of_rows(row)
            dealt = runs.rows(runs.hashed(4) % row.column("splits")[0].as_py())
            part = pa.array([row.column("part")[0].as_py()] * dealt.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part, *dealt.columns[1:], dealt.column("part")], schema=SPLIT_RUNS)


SPLIT_RUNS = RUNS.append(pa.field("split", pa.int64()))


def _counter(least: int):
    """Add up the runs of one part, then what flows through its nodes, word by word.

    Runs of three and four words are complete here. Those of two may be spread over the splits of a
    part, and words over all parts: what a part has of them is added up afterwards.
    """

    def counted(table: pa.Table) -> pa.Table:
        runs = runs_of_rows(table)
        whole = table.column("splits")[0].as_py() == 1
        out = []
        for width in range(WORDS, 0, -1):
            found = runs.where(runs.sizes() == width)
            if width > 2 or (width == 2 and whole):
                found = found.where(found.counts >= least)
            out.append(found.phrases())
            runs = runs.shortened() if width > 1 else runs
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out)

    return counted


def phrase_counts(
    documents: DataFrame,
    scratch: Scratch,
    least: int = LEAST,
    lang: str = "lang",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    part_bytes: int = PART_BYTES,
    split_rows: int = SPLIT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, f)`` of all phrases of up to four words that occur ``least`` times or
    more, and ``(lang, n)``, the number of all words. Words are joined by a space.

    A part of the key space holds all runs that begin with the same two words, so that counts of
    four, three and two words come from one shuffle. A part of over ``split_rows`` runs, as that of
    a pair of words with a third of all places, is dealt out by the third word.
    """
    given = documents.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # One number.
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // part_bytes))
    runs = "part bigint, n bigint, words binary, codes binary, counts binary"
    edges = scratch.store(given.mapInArrow(_edge_maker(parts, chunk_bytes), runs), "edges")
    large = (
        edges.groupBy("part").agg(F.sum("n").alias("rows")).where(F.col("rows") > split_rows)
        .select("part", F.ceil(F.col("rows") / split_rows * 2).cast("bigint").alias("splits"))
    )
    # At most one row for every SPLIT_ROWS runs of the corpus.
    marked = edges.join(F.broadcast(large), "part", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    whole = marked.where("splits = 1").withColumn("split", F.lit(0).cast("bigint"))
    dealt = (
        marked.where("splits > 1")
        .mapInArrow(_splitter, f"{runs}, split bigint")
        .withColumn("splits", F.lit(2).cast("bigint"))
    )
    partial = (
        whole.unionByName(dealt)
        .groupBy("part", "split")
        .applyInArrow(_counter(least), "lang string, size int, phrase string, f bigint")
    )
    counted = scratch.store(partial.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")), "counts")
    scratch.drop(edges)
    totals = counted.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    return counted.where(F.col("f") >= least), totals


def _part(first, last):
    """Words ``first`` to ``last`` of ``words``, joined."""
    return F.array_join(F.slice("words", first, last), " ")


def unary_paths(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(path, piece, nodes, inner)``: chains of nodes with one way on and one way in.

    ``edges`` is ``(u, v, f)`` of BIGINT nodes. A chain's nodes are listed in their order with
    ``inner`` the weights of the edges between them, in pieces of ``PATH_ROWS`` links. Heads are
    found by doubling pointers: a round joins all pointers once, and is stored. A ring has no
    head: its edges are no chain.
    """
    out = edges.groupBy("u").agg(F.count("*").alias("n_out"))
    into = edges.groupBy("v").agg(F.count("*").alias("n_in"))
    single = edges.join(out.where("n_out = 1").select("u"), "u").join(into.where("n_in = 1").select("v"), "v")
    links = scratch.store(single.where("u <> v").select("u", "v", "f"), "unary_links")
    now = scratch.store(
        links.select(F.col("v").alias("node"), F.col("u").alias("back"), F.lit(1).cast("bigint").alias("steps")),
        "pointers",
    )
    # Nodes with no way back that is unary are heads: pointers end there.
    open_before = None
    while True:
        to = now.select(F.col("node").alias("back"), F.col("back").alias("further"), F.col("steps").alias("more"))
        after = scratch.store(
            now.join(to, "back", "left").select(
                "node",
                F.coalesce("further", "back").alias("back"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.col("further").isNotNull().alias("open"),
            ),
            "pointers",
        )
        scratch.drop(now)
        now = after.drop("open")
        now.stored_at = after.stored_at
        # One number. Chains leave no length out, so once a round closes none, rings alone are open.
        n_open = after.where("open").count()
        if n_open == 0 or n_open == open_before:
            break
        open_before = n_open
    closed = after.where(~F.col("open"))
    placed = links.join(closed, links["v"] == closed["node"]).select(
        F.col("back").alias("path"),
        F.floor((F.col("steps") - 1) / PATH_ROWS).alias("piece"),
        "steps",
        "u",
        "v",
        "f",
    )
    chained = placed.groupBy("path", "piece").agg(
        F.array_sort(F.collect_list(F.struct("steps", "u", "v", "f"))).alias("links")
    )
    return chained.select(
        "path",
        "piece",
        F.concat(F.slice("links.u", 1, 1), F.col("links.v")).alias("nodes"),
        F.col("links.f").alias("inner"),
    )


def _greatest_around(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, around)``: the greatest weight of an edge at each node.

    Inside a unary path that is the greater one of two neighbours in a list; only other edges, and
    the ends of paths, are compared by node.
    """
    edges = scratch.store(edges, "edges")
    paths = scratch.store(unary_paths(edges, scratch), "paths")
    inside = paths.select(F.posexplode("nodes").alias("i", "node"), "inner").select(
        "node",
        F.greatest(
            F.when(F.col("i") > 0, F.get("inner", F.col("i") - 1)), F.get("inner", F.col("i"))
        ).alias("around"),
    )
    chained = paths.select(F.posexplode("inner").alias("i", "f"), "nodes").select(
        F.get("nodes", F.col("i")).alias("u"), F.get("nodes", F.col("i") + 1).alias("v")
    )
    others = edges.join(chained, ["u", "v"], "left_anti")
    ends = others.select(F.explode(F.array("u", "v")).alias("node"), F.col("f").alias("around"))
    return inside.unionByName(ends).groupBy("node").agg(F.max("around").alias("around"))


def mine_collocations(
    documents: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    lang: str = "lang",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    part_bytes: int = PART_BYTES,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    A phrase of two to four words counts if it occurs ``least`` times or more inside pieces. Its
    score is the lowest, over the cuts in two parts, of floor(2000000 a / (l + r)). A phrase that
    lies inside a longer one of at least 0.8 of its occurrences is left out; since a longer phrase
    occurs no more often than its own parts, phrases longer by one word decide. Numbers are whole and
    products decimal. Null languages are ``und``, null texts empty; no words give no rows, repeated
    rows count again. Other columns are not read.
    """
    scratch = Scratch(documents.sparkSession)
    found, n = phrase_counts(
        documents, scratch, least, lang, text, chunk_bytes, part_bytes, split_rows
    )
    phrases = scratch.store(found.select(F.monotonically_increasing_id().alias("id"), "*"), "phrases")
    longer = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"), F.col("id").alias("part_id"))

    def with_part(rows: DataFrame, column: str, out: str, what: str) -> DataFrame:
        named = known.select("lang", F.col("part").alias(column), F.col(what).alias(out))
        return rows.join(named, ["lang", column])

    cuts = longer.select(
        "id", "lang", "size", "phrase", F.col("f").alias("a"), "words",
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    )
    cuts = cuts.withColumn("left", _part(F.lit(1), F.col("k"))).withColumn(
        "right", _part(F.col("k") + 1, F.col("size") - F.col("k"))
    )
    cuts = with_part(with_part(cuts, "left", "l", "part_f"), "right", "r", "part_f")
    lowest = (
        cuts.withColumn("score", F.expr("cast(a as decimal(19, 0)) * 2000000 div (cast(l as decimal(19, 0)) + r)"))
        .groupBy("id", "lang", "size", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("id", "lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    # Phrases of one size are the nodes, those of one word more the edges between them.
    dropped = None
    for size in range(2, WORDS):
        edge = longer.where(F.col("size") == size + 1).select(
            "lang", "f", _part(F.lit(1), F.lit(size)).alias("left"), _part(F.lit(2), F.lit(size)).alias("right")
        )
        named = with_part(with_part(edge, "left", "u", "part_id"), "right", "v", "part_id")
        around = _greatest_around(named.select("u", "v", "f"), scratch)
        dropped = around if dropped is None else dropped.unionByName(around)
    wide = "decimal(38, 0)"
    kept = lowest.join(dropped.withColumnRenamed("node", "id"), "id", "left").where(
        F.col("around").isNull() | (F.col("around").cast(wide) * 100 < F.col("a").cast(wide) * 80)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # The limit is applied in every task before a language's rows come together.
    ranked = (
        kept.select("lang", "phrase", "a", "l", "r", "score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )
    return ranked.join(n, "lang").select(
        F.col("lang").alias(lang), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
