"""Language of whole texts: known words by their frequency, unseen ones by shorter and shorter grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch, in_fold

UNDETERMINED = "und"
# The classifier is fitted on about this many labelled documents of each language, chosen by a hash
# of their key and text, and keeps the most frequent words and grams of each length.
SAMPLE = 5000
WORDS, GRAMS = 1 << 16, 1 << 15
LONGEST = 5
# Words whose evidence counts in full: longer texts are as sure as one of so many words.
EVIDENCE = 30
# Words that a task remembers besides the model's.
REMEMBERED = 1 << 18

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    found = WORD.findall((text or "").lower())
    return found if any(any(map(str.isalpha, word)) for word in found) else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prior: np.ndarray
    words: dict[str, int]
    word_scores: np.ndarray
    grams: tuple[dict[str, int], ...]  # of length 1, 2, ...
    gram_scores: tuple[np.ndarray, ...]


def _log_frequencies(table: list, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Rows (item, {language: count}) to an index and smoothed log frequencies by language."""
    counts = np.zeros((len(table), len(languages)))
    for i, (_, by_language) in enumerate(table):
        for j, language in enumerate(languages):
            counts[i, j] = by_language.get(language, 0)
    scores = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(table))))
    return {item: i for i, (item, _) in enumerate(table)}, scores


def fit_languages(
    documents: DataFrame,
    key: str = "doc_id",
    language: str = "lang",
    text: str = "text",
    sample: int = SAMPLE,
    words: int = WORDS,
    grams: int = GRAMS,
) -> LanguageModel:
    """Count words and grams by language over a bounded sample of labelled documents.

    Every table that reaches the driver is bounded: one row for each language, ``words`` words, and
    ``grams`` grams of each length up to five, with one count for each language.
    """
    labelled = documents.select(
        F.col(language).alias("language"), F.col(text).alias("text"), F.col(key).alias("key")
    ).where("language is not null and text is not null")
    sizes = {r["language"]: r["count"] for r in labelled.groupBy("language").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel((), np.zeros(0), {}, np.zeros((0, 0)), (), ())
    share = F.create_map(
        *[F.lit(x) for name in languages for x in (name, min(1.0, sample / sizes[name]))]
    )[F.col("language")]
    place = F.shiftrightunsigned(F.xxhash64("key", "text"), 11) / float(1 << 53)
    chosen = labelled.where(place < share).select("language", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def told():
            rows = [
                (language, 0, word, n) for language, own in counts.items() for word, n in own.items()
            ]
            for language, own in counts.items():
                short: Counter = Counter()
                for word, n in own.items():
                    for size in range(1, LONGEST + 1):
                        for gram in grams_of(word, size):
                            short[size, gram] += n
                rows += [(language, size, gram, n) for (size, gram), n in short.items()]
            counts.clear()
            return pa.RecordBatch.from_pylist(
                [dict(zip(("language", "size", "item", "n"), row)) for row in rows],
                pa.schema(
                    [("language", pa.string()), ("size", pa.int32()), ("item", pa.string()), ("n", pa.int64())]
                ),
            )

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(name, Counter()).update(words_of(value))
            if sum(map(len, counts.values())) > REMEMBERED:
                yield told()
        yield told()

    scratch = Scratch(documents.sparkSession)
    counted = scratch.store(
        chosen.mapInArrow(count, "language string, size int, item string, n bigint")
        .groupBy("size", "item", "language").agg(F.sum("n").alias("n"))
        .groupBy("size", "item")
        .agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("counts"),
             F.sum("n").alias("n"))
        .where("n > 1"),
        "counts",
    )
    tables = [
        [
            (row["item"], row["counts"])
            for row in counted.where(F.col("size") == size)
            .orderBy(F.desc("n"), "item").limit(words if size == 0 else grams).collect()
        ]
        for size in range(LONGEST + 1)
    ]
    fitted = [_log_frequencies(table, languages) for table in tables]
    total = sum(sizes.values())
    return LanguageModel(
        tuple(languages),
        np.log([sizes[name] / total for name in languages]),
        fitted[0][0],
        fitted[0][1],
        tuple(index for index, _ in fitted[1:]),
        tuple(scores for _, scores in fitted[1:]),
    )


class Scorer:
    """Scores of words by language, each worked out once."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self._start()

    def _start(self) -> None:
        base = self.model.word_scores
        self.scores = np.zeros((max(1024, 2 * len(base)), len(self.model.languages)))
        self.scores[: len(base)] = base
        self.index = _Index(self, self.model.words)

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the longest grams that are known; nothing known tells nothing."""
        for size in range(LONGEST, 0, -1):
            index = self.model.grams[size - 1]
            known = [index[g] for g in grams_of(word, size) if g in index]
            if known:
                return self.model.gram_scores[size - 1][known].mean(axis=0)
        return np.zeros(len(self.model.languages))

    def add(self, word: str) -> int:
        place = len(self.index)
        if place >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[place] = self.unseen(word)
        return place

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        if len(self.index) > len(self.model.words) + REMEMBERED:
            self._start()
        places = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        total = self.scores[places].sum(axis=0) * min(1.0, EVIDENCE / len(words))
        total += self.model.prior
        chance = np.exp(total - total.max())
        chance /= chance.sum()
        best = int(np.argmax(chance))
        return self.model.languages[best], float(chance[best])


class _Index(dict):
    def __init__(self, scorer: Scorer, words: dict[str, int]) -> None:
        super().__init__(words)
        self.scorer = scorer

    def __missing__(self, word: str) -> int:
        place = self[word] = self.scorer.add(word)
        return place


def language_of(text: str | Column, model: LanguageModel) -> Column:
    """Struct of the predicted language ``lang_pred`` and its probability ``score``."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.DataFrame(
                [scorer.predict(value) for value in texts], columns=["lang_pred", "score"]
            )

    return predict(text)


def identify_languages(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    folds: int = 4,
    held_out: int = 2,
) -> DataFrame:
    """``(key, held_out, lang_pred, score)`` for every row.

    A known word adds its log frequency in each language. An unseen word adds the mean log
    frequency of its longest known grams: five letters and word ends, else four, down to one.
    ``score`` is the probability of the best language, with the evidence of longer texts scaled to
    that of 30 words. Ties go to the language that sorts first. Texts that are null or have no
    letter are ``und`` with score 0, as are all if no row has a language. Rows with a null key are
    predicted and not learned from. Repeated rows are returned each. Other columns are not read.
    """
    out = in_fold(key, folds, held_out)
    model = fit_languages(documents.where(~out & F.col(key).isNotNull()), key, language, text)
    found = documents.select(
        F.col(key).alias(key), out.alias("held_out"), language_of(F.col(text), model).alias("found")
    )
    return found.select(key, "held_out", "found.lang_pred", "found.score")
