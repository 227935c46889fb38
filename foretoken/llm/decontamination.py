"""Documents that contain benchmark items: BM25 with block-max pruning, then overlap of both parts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch

K1, B = 1.2, 0.75
SHINGLE, OVERLAP = 5, 0.8
# Each of question and answer must be there as well, at least by this share of its shingles.
PART = 0.5
# Items of one block of the index share a bound.
BLOCK = 4
# Items and bytes of text that one index holds, about; a larger benchmark is searched in several.
INDEX_ITEMS, INDEX_BYTES = 1024, 1 << 20
# Words between the starts of passages, at least; a passage has two strides.
STRIDE = 32
# Tokens whose word a task remembers.
REMEMBERED = 1 << 18

TRIM = ".,;:?!\"'()[]{}<>…«»„“”‘’`~|*_#&%/\\-–—"
ANSWER = re.compile(r"(?:^|\s)(?:answer|a)\s*:\s*", re.I)
SENTENCE_END = re.compile(r"[.!?]+\s+(?=\S)")


def words_of(text: str | None) -> list[str]:
    """Lower-case tokens without white space, without marks at their ends."""
    return [w for w in (token.strip(TRIM) for token in (text or "").lower().split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words before and after its answer mark; else its last sentence answers the rest;
    of a single sentence, its last quarter."""
    marks = [m for m in ANSWER.finditer(text) if words_of(text[: m.start()])]
    if marks:
        question, answer = text[: marks[-1].start()], text[marks[-1].end() :]
    else:
        ends = [m.end() for m in SENTENCE_END.finditer(text) if words_of(text[m.end() :])]
        question, answer = (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")
    asked, answered = words_of(question), words_of(answer)
    if not answered:
        cut = len(asked) - max(1, len(asked) // 4)
        asked, answered = asked[:cut], asked[cut:]
    return asked, answered


def shingles_of(words: list[str]) -> list[tuple[str, ...]]:
    size = min(SHINGLE, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []


@dataclass
class Item:
    key: int | None
    words: list[str]
    shingles: list[tuple[str, ...]]
    answered: int  # shingles from here on hold a word of the answer
    unmarked: Item | None = None  # the same without the words of its answer mark

    def overlaps(self, found: set[tuple[str, ...]]) -> tuple[float, float, float]:
        """Shares of the question's, the answer's and all shingles."""
        hits = [shingle in found for shingle in self.shingles]
        asked, answered = hits[: self.answered], hits[self.answered :]
        whole = sum(hits) / len(hits)
        return (
            sum(asked) / len(asked) if asked else whole,
            sum(answered) / len(answered) if answered else whole,
            whole,
        )


def greatest_loss(weights: np.ndarray, n_shingles: int, lost: int) -> float:
    """The most weight that words of an item can have whose absence costs at most ``lost`` shingles.

    Over positions from left to right: for each number of lost shingles, the greatest weight of
    absent words of which this one is the last. A word takes the shingles that hold it and no
    earlier absent word.
    """
    never = np.full(lost + 1, -np.inf)
    last: list[np.ndarray] = []
    far = never.copy()  # over all last words at least a shingle away, or none
    far[0] = 0.0
    for p, weight in enumerate(weights.tolist()):
        if p >= SHINGLE:
            far = np.maximum(far, last[p - SHINGLE])
        here = never.copy()
        for before, start in [(far, 0), *[(last[q], q + 1) for q in range(max(0, p - SHINGLE + 1), p)]]:
            new = min(p, n_shingles - 1) - max(p - SHINGLE + 1, start, 0) + 1
            new = max(0, new)
            if new <= lost:
                here[new:] = np.maximum(here[new:], before[: lost + 1 - new] + weight)
        last.append(here)
    return max(0.0, float(far.max()), *(float(one.max()) for one in last[-SHINGLE:]))


def make_item(key: int | None, text: str) -> Item | None:
    """An item as it stands, its answer mark included as documents have it, and without the mark."""
    asked, answered = question_and_answer(text)

    def of(words: list[str]) -> Item:
        shingles = shingles_of(words)
        first = len(words) - len(answered)
        return Item(key, words, shingles, max(0, min(len(shingles), first - SHINGLE + 1)))

    if not asked + answered:
        return None
    item = of(words_of(text))
    if item.words != asked + answered:
        item.unmarked = of(asked + answered)
    return item


@dataclass
class Index:
    """Postings of items by term, and bounds by block.

    Weights are BM25 weights over the least score at which an item can pass verification: its own
    score without the heaviest words that its lost shingles can take along. So a passage that
    holds an item has a score of at least 1 for it, and retrieval loses none.
    """

    items: list[Item]  # with a second form for those with an answer mark
    rows: list[int] = field(default_factory=list)  # equal for both forms of an item
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    bounds: np.ndarray | None = None  # the greatest weight of a term in each block; last row: none

    def __post_init__(self) -> None:
        # Neighbours in a block should share terms; length is a cheap stand-in.
        forms = [
            (form, row) for row, item in enumerate(self.items) for form in (item, item.unmarked) if form
        ]
        forms.sort(key=lambda one: (len(one[0].words), one[0].words))
        self.items, self.rows = [form for form, _ in forms], [row for _, row in forms]
        counts = [Counter(item.words) for item in self.items]
        lengths = [len(item.words) for item in self.items]
        mean = sum(lengths) / max(1, len(lengths))
        holders: dict[str, list[int]] = {}
        for i, own in enumerate(counts):
            for term in own:
                holders.setdefault(term, []).append(i)
        n = len(self.items)
        totals = np.zeros(n)
        raw = []
        for term in sorted(holders):
            held = np.array(holders[term])
            idf = math.log(1 + (n - len(held) + 0.5) / (len(held) + 0.5))
            tf = np.array([counts[i][term] for i in held], float)
            norm = K1 * (1 - B + B * np.array([lengths[i] for i in held]) / mean)
            weight = idf * tf * (K1 + 1) / (tf + norm)
            self.terms[term] = len(raw)
            raw.append((held, weight))
            totals[held] += weight
        needed = np.zeros(n)
        for i, item in enumerate(self.items):
            own = np.zeros(len(item.words))
            for p, word in enumerate(item.words):
                held, weight = raw[self.terms[word]]
                own[p] = weight[np.searchsorted(held, i)] / counts[i][word]
            lost = math.floor((1 - OVERLAP) * len(item.shingles) + 1e-9)
            needed[i] = totals[i] - greatest_loss(own, len(item.shingles), lost)
        needed = np.maximum(needed, 0.05 * totals) * (1 - 1e-9)
        self.postings = [(held, weight / needed[held]) for held, weight in raw]
        blocks = -(-n // BLOCK)
        self.bounds = np.zeros((len(raw) + 1, max(1, blocks)), np.float32)
        for t, (held, weight) in enumerate(self.postings):
            np.maximum.at(self.bounds[t], held // BLOCK, weight)

    @property
    def stride(self) -> int:
        """Any stretch of so many words lies whole in a passage of two strides."""
        return max(STRIDE, max(len(item.words) for item in self.items) * 9 // 8)

    def search(self, terms: list[int], least: float = 1.0) -> list[tuple[int, float]]:
        """All items whose weights over distinct ``terms`` sum to ``least``: block-max WAND.

        Posting lists are kept in order of their next item. The pivot is the first item at which
        the lists' greatest weights can reach ``least``; its block's bounds decide whether it is
        scored, or the lists skip to where the bound can change.
        """
        least -= 1e-6  # sums in another order, bounds in single precision
        lists = [[0, *self.postings[t], float(self.postings[t][1].max()), t] for t in terms]
        found = []
        while lists:
            lists.sort(key=lambda one: one[1][one[0]])
            reach, pivot = 0.0, None
            for k, one in enumerate(lists):
                reach += one[3]
                if reach >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = int(lists[pivot][1][lists[pivot][0]])
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == item:
                pivot += 1
            block = item // BLOCK
            if sum(float(self.bounds[one[4], block]) for one in lists[: pivot + 1]) < least:
                # No item of this block before the next list begins can reach it.
                target = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    target = min(target, int(lists[pivot + 1][1][lists[pivot + 1][0]]))
                target = max(target, item + 1)
                moved = lists[: pivot + 1]
            else:
                if lists[0][1][lists[0][0]] == item:
                    score = sum(float(one[2][one[0]]) for one in lists[: pivot + 1])
                    if score >= least:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
                moved = lists[: pivot + 1]
            for one in moved:
                one[0] += int(np.searchsorted(one[1][one[0] :], target))
            lists = [one for one in lists if one[0] < len(one[1])]
        return found


class Searcher:
    """Verified items of one text after another."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.memory = _Terms(index)

    def find(self, text: str | None) -> list[tuple[int | None, float, float, float, float]]:
        """(item, score, overlaps of question, answer, all) of its best passage, if verified."""
        index = self.index
        tokens = (text or "").lower().split()
        if not tokens or not index.items:
            return []
        if len(self.memory) > REMEMBERED:
            self.memory = _Terms(index)
        ids = np.fromiter(map(self.memory.__getitem__, tokens), np.int64, len(tokens))
        if (ids < 0).any():
            # Tokens of marks alone are no words.
            kept = ids >= 0
            tokens = [token for token, keep in zip(tokens, kept.tolist()) if keep]
            ids = ids[kept]
        # Bounds of all passages, summed over their distinct terms.
        stride, none = index.stride, len(index.postings)
        known = np.flatnonzero(ids < none)
        if not len(known):
            return []
        part = known // stride
        cells = np.concatenate([part, part[part > 0] - 1]) * none
        cells += np.concatenate([ids[known], ids[known][part > 0]])
        cells = np.unique(cells)
        passage = cells // none
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        reach = np.add.reduceat(index.bounds[cells % none], first, axis=0).max(axis=1)
        ends = np.append(first[1:], len(cells))
        best: dict[int, tuple] = {}
        keys: dict[int, int | None] = {}
        for k in np.flatnonzero(reach >= 1.0 - 1e-4).tolist():
            retrieved = index.search((cells[first[k] : ends[k]] % none).tolist())
            if not retrieved:
                continue
            start = int(passage[first[k]]) * stride
            words = [token.strip(TRIM) for token in tokens[start : start + 2 * stride]]
            for i, score in retrieved:
                item = index.items[i]
                size = len(item.shingles[0])
                seen = set(zip(*[words[j:] for j in range(size)]))
                asked, answered, whole = item.overlaps(seen)
                if whole >= OVERLAP - 1e-9 and min(asked, answered) >= PART:
                    one = (whole, asked, answered, score)
                    row = index.rows[i]
                    keys[row] = item.key
                    best[row] = max(one, best.get(row, one))
        return sorted(
            ((keys[row], score, q, a, whole) for row, (whole, q, a, score) in best.items()),
            key=lambda row: (row[0] is not None, row[0] or 0, row[1:]),
        )


class _Terms(dict):
    """Tokens to terms of the index; other words are one past the last, mere marks -1."""

    def __init__(self, index: Index) -> None:
        super().__init__()
        self.index = index

    def __missing__(self, token: str) -> int:
        word = token.strip(TRIM)
        found = self.index.terms.get(word, len(self.index.postings)) if word else -1
        self[token] = found
        return found


FOUND = (
    "array<struct<item:bigint,score:double,question_overlap:double,answer_overlap:double,"
    "overlap:double>>"
)


def items_in(text: str | Column, index: Index) -> Column:
    """Array of the index's verified items in a text."""

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(index)
        names = ("item", "score", "question_overlap", "answer_overlap", "overlap")
        for texts in batches:
            yield pd.Series(
                [[dict(zip(names, row)) for row in searcher.find(value)] for value in texts]
            )

    return find(text)


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes that together hold all items, each of a bounded part of them.

    Items are dealt by a hash of their row, written by part and read part by part, so the driver
    holds one part. Those of one part whose lengths differ much have indexes of their own, as
    passages are cut to the longest item.
    """
    rows = benchmark.select(
        F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")
    ).where("text is not null")
    n, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // INDEX_ITEMS), -(-n_bytes // INDEX_BYTES))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key", "text"), F.lit(parts)))
    if parts > 1:
        scratch = Scratch(benchmark.sparkSession)
        dealt = scratch.store(dealt.repartition(parts, "part").sortWithinPartitions("part"), "items")
    for part in range(parts):
        own = dealt.where(F.col("part") == part)
        by_length: dict[int, list[Item]] = {}
        for row in own.toLocalIterator():
            if item := make_item(row["key"], row["text"]):
                by_length.setdefault(max(64, len(item.words)).bit_length(), []).append(item)
        for _, items in sorted(by_length.items()):
            yield Index(items)


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id"
) -> DataFrame:
    """The rows of ``documents`` in whose text no item of the benchmark was found, all columns kept.

    What one index leaves is written before the next searches it, so at most two are held at a time.
    Null and empty texts, rows without a key and repeated rows stay as they are.
    """
    kept, scratch, stored = documents, Scratch(documents.sparkSession), None
    for number, index in enumerate(indexes(benchmark, item)):
        if number:
            former, stored = stored, scratch.store(kept, "kept")
            if former is not None:
                scratch.drop(former)
            kept = stored
        kept = kept.where(F.size(items_in(kept[text], index)) == 0)
    return kept


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
) -> DataFrame:
    """``(key, item, score, question_overlap, answer_overlap, overlap)`` for every leaked item.

    Every passage of every document queries an index of the items by BM25 and retrieves all items
    that it can hold. These are verified: four fifths of the item's shingles of five words lie in
    the passage, and half of those of its question and of its answer. An item of fewer than five
    words is one shingle. ``score`` is over the least score at which the item could be verified.

    A benchmark of more than one index is searched index by index: the hits of each are written
    before the next is made, so driver and tasks hold one at a time.

    Null and empty documents hold no item, null and wordless items lie in no document. Equal items
    are each returned, as are repeated documents; null keys are kept. Other columns are not read.
    """
    scratch, parts = Scratch(documents.sparkSession), []
    for index in indexes(benchmark, item):
        hits = documents.select(
            F.col(key).alias("_key"), F.explode(items_in(F.col(text), index)).alias("_found")
        )
        parts.append(scratch.store(hits, "hits"))
        del index, hits
    if not parts:
        nothing = F.array().cast(FOUND)
        parts = [documents.select(F.col(key).alias("_key"), F.explode(nothing).alias("_found"))]
    return reduce(DataFrame.unionAll, parts).select(
        F.col("_key").alias(key), F.col("_found.item").alias(item), "_found.score",
        "_found.question_overlap", "_found.answer_overlap", "_found.overlap",
    )
