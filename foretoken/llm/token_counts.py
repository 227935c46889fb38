"""Count the tokens of whole texts under a unigram vocabulary, without making the tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Fixed value: how far an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
# Segments whose counts a task remembers; beyond it the memory starts anew.
REMEMBERED = 1 << 19


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and their scores. ``byte_fallback``: an unknown character is as many tokens as bytes."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_fallback: bool = True


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in ids),
        tuple(model.get_score(i) for i in ids),
        any(model.is_byte(i) for i in ids),
    )


class Counter:
    """Best-scoring segmentation, carried as score and piece count only.

    An Aho-Corasick automaton gives the pieces that end at each character, longest first. A later
    candidate for the same end replaces an earlier one only if its score is greater, so of equal
    ones the longest last piece stays, as in a search that goes through starts from left to right.
    A character that is no piece by itself may also be an unknown one, tried last. Scores are added
    in double precision in the order of the text.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores):
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = min(vocabulary.scores) - UNKNOWN_PENALTY
        self.byte_fallback = vocabulary.byte_fallback
        joined = [p for p in vocabulary.pieces if len(p) > 1]
        # A text falls apart where no piece can reach across: before a space mark after another
        # character, and around line ends. Whole scores then add up alike in any order.
        self.apart = (
            SPACE in self.single
            and all(float(s).is_integer() for s in vocabulary.scores)
            and not any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in joined)
            and (self.byte_fallback or "\n" in self.single)
        )
        self.line_end = 0
        if self.apart:
            self.line_end = self.of_segment("\n")
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def of_segment(self, segment: str) -> int:
        """Number of tokens of an already marked text."""
        size = len(segment)
        best: list = [0.0] + [None] * size
        count = [0] * (size + 1)
        open_run = [False] * (size + 1)
        single, unknown = self.single, self.unknown
        at = 1

        def unknown_at(end):
            if segment[end - 1] in single:
                return
            score = best[end - 1] + unknown
            if best[end] is None or score > best[end]:
                best[end] = score
                if self.byte_fallback:
                    count[end] = count[end - 1] + len(segment[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    count[end] = count[end - 1] + (not open_run[end - 1])
                    open_run[end] = True

        for end, (length, add) in self.automaton.iter(segment):
            end += 1
            while at < end:
                unknown_at(at)
                at += 1
            start = end - length
            score = best[start] + add
            if best[end] is None or score > best[end]:
                best[end] = score
                count[end] = count[start] + 1
        while at <= size:
            unknown_at(at)
            at += 1
        return count[size]

    def _known(self, memory: dict[str, int], word: str, mark: str) -> int:
        found = memory.get(word)
        if found is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            found = memory[word] = self.of_segment(mark + word)
        return found

    def of_text(self, text: str | None) -> int:
        """Tokens of a text whose spaces become space marks, with one more in front."""
        if not text:
            return 0
        if not self.apart:
            return self.of_segment(SPACE + text.replace(" ", SPACE))
        lines = text.replace(SPACE, " ").split("\n")
        total = self.line_end * (len(lines) - 1)
        for number, line in enumerate(lines):
            words = line.split(" ")
            if "" in words:
                # Runs of spaces, or a space at an end of the line.
                marked = (" " if number == 0 else "") + line
                for part in re.findall(r" *[^ ]+| +", marked):
                    total += self._known(self.first, part.replace(" ", SPACE), "")
                continue
            if number:
                total += self._known(self.first, words[0], "")
                words = words[1:]
            later = self.later
            for word in words:
                found = later.get(word)
                total += self._known(later, word, SPACE) if found is None else found
        return total


def count_tokens(
    documents: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_tokens)`` for every row; a null or empty text has no token.

    Null keys and repeated rows are returned as they come. Other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            counts = [counter.of_text(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], ["key", "n_tokens"]
            )

    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "key bigint, n_tokens bigint").withColumnRenamed("key", key)
