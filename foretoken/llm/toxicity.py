"""Toxicity of whole texts: a noisy channel is undone before words are looked at.

Writers hide words by look-alike characters, by spaces between letters and by repeated letters. A
span that may be hidden becomes a lattice of characters; Viterbi decoding under a character language
model picks the likeliest reading; the restored words are scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch, in_fold

# Words of the labelled documents, most frequent in either label first, that the character model
# learns from: it is held by every task.
WORDS = 1 << 15
ORDER = 4
LIMIT = 0.7
# A word is evidence if it has this many different neighbours in documents labelled 1, and if at
# least this share of all its neighbours comes from such documents.
# The share is the lower end of a confidence interval of so many standard errors: of many rare words
# some are found in such documents only by chance.
NEIGHBOURS, PURITY, ERRORS = 5, 0.6, 1.5
# Each of so many parts of the labelled documents tells how sure the evidence of the other parts is;
# the words come from all parts.
PARTS = 4
# Different words that a task counts before it sends them, and documents whose words it sends at once.
COUNTED, SENT = 1 << 17, 512
# Tokens whose decoded words a task remembers.
REMEMBERED = 1 << 18

# What a character may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
    "*": "aeiou",
}
SEPARATORS = " .-_*·"
# Log probabilities of the channel: a look-alike, a kept odd character, a dropped separator, a kept
# one, a repeated letter.
SWAP, ODD, JOIN, PART, REPEAT = -2.0, -9.0, -0.5, -3.0, -0.7

EDGE = " "
# Three or more single characters with white space between.
SPACED = re.compile(r"(?<!\S)[^\s](?:[ \t][^\s](?!\S)){2,}")
SPACED_INSIDE = re.compile(r"^[^\W_](?:[.\-_*·][^\W_]){2,}$")
TWICE = re.compile(r"([^\W\d_])\1")
THRICE = re.compile(r"([^\W\d_])\1\1")
TRIM = ".,;:?!\"'()[]{}<>…«»„“”‘’`~#&%/\\=^"
LETTERS = re.compile(r"[^\W\d_]+")


class CharacterModel:
    """Character n-grams with interpolated lower orders; words are told apart by an edge."""

    def __init__(self, words: dict[str, float], order: int = ORDER) -> None:
        self.order, self.words = order, words
        counts: list[Counter] = [Counter() for _ in range(order)]
        totals: list[Counter] = [Counter() for _ in range(order)]
        for word, weight in words.items():
            marked = EDGE + word + EDGE
            for i in range(1, len(marked)):
                for k in range(order):
                    if i >= k:
                        context = marked[i - k : i]
                        counts[k][context + marked[i]] += weight
                        totals[k][context] += weight
        self.counts, self.totals = counts, totals
        self.alphabet = max(1, len(counts[0])) + 1
        self.memory: dict[tuple[str, str], float] = {}

    def log_chance(self, context: str, char: str) -> float:
        found = self.memory.get((context, char))
        if found is None:
            chance = 1.0 / self.alphabet
            for k in range(min(len(context), self.order - 1) + 1):
                tail = context[len(context) - k :]
                total = self.totals[k].get(tail, 0.0)
                chance = (self.counts[k].get(tail + char, 0.0) + 2e-4 * chance) / (total + 2e-4)
            found = self.memory[context, char] = math.log(max(chance, 1e-30))
        return found


def lattice(span: str) -> list[list[tuple[int, str, float]]]:
    """From each position: (next position, characters read, log probability of the channel)."""
    arcs: list[list[tuple[int, str, float]]] = [[] for _ in span]
    for i, char in enumerate(span):
        if char in SEPARATORS and 0 < i < len(span) - 1:
            arcs[i] += [(i + 1, "", JOIN), (i + 1, EDGE, PART)]
        if char.isalpha():
            arcs[i].append((i + 1, char, 0.0))
            end = i + 1
            while end < len(span) and span[end] == char:
                end += 1
            # A run is entered at its first letter only.
            if end - i >= 2 and (i == 0 or span[i - 1] != char):
                arcs[i].append((end, char, REPEAT))
                if end - i > 2:
                    arcs[i].append((end, char + char, REPEAT))
        for letter in LOOKALIKE.get(char, ""):
            arcs[i].append((i + 1, letter, SWAP))
        if not char.isalpha() and not (char in SEPARATORS and arcs[i]):
            arcs[i].append((i + 1, EDGE, ODD))
    return arcs


def restore(span: str, model: CharacterModel) -> str:
    """The likeliest reading of a span: words, with spaces between. Ties go to the first in order."""
    keep = model.order - 1
    states: list[dict[str, tuple[float, tuple]]] = [{} for _ in range(len(span) + 1)]
    states[0][EDGE] = (0.0, ())
    for i, leaving in enumerate(lattice(span)):
        for context, (score, read) in states[i].items():
            for after, chars, cost in leaving:
                total, tail = score + cost, context
                for char in chars:
                    if char == EDGE and tail.endswith(EDGE):
                        continue
                    total += model.log_chance(tail, char)
                    tail = (tail + char)[-keep:] if keep else ""
                old = states[after].get(tail)
                if old is None or total > old[0]:
                    states[after][tail] = (total, (read, chars))
        states[i] = {}
    best = max(
        states[-1].items(),
        key=lambda item: item[1][0]
        + (0.0 if item[0].endswith(EDGE) else model.log_chance(item[0], EDGE)),
    )
    parts, read = [], best[1][1]
    while read:
        parts.append(read[1])
        read = read[0]
    return " ".join("".join(reversed(parts)).split())


def is_hidden(token: str) -> bool:
    """Whether a token without white space has more than one reading worth decoding."""
    if token.isalpha():
        return THRICE.search(token) is not None
    if SPACED_INSIDE.match(token):
        return True
    letters = sum(map(str.isalpha, token))
    odd = sum(c in LOOKALIKE for c in token)
    return letters > 0 and 0 < odd <= letters + 1 and letters + odd == len(token) or (
        letters > 0 and THRICE.search(token) is not None
    )


def may_hide(token: str) -> bool:
    """Whether a token has a look-alike, a separator inside or a letter twice.

    Many such tokens are plain words: their reading is looked at beside the plain form.
    """
    if token.isalpha():
        return TWICE.search(token) is not None
    return any(map(str.isalpha, token)) and (
        any(c in LOOKALIKE for c in token)
        or any(c in SEPARATORS for c in token[1:-1])
        or TWICE.search(token) is not None
    )


class Reader:
    """Words of a text after restoring, with the readings of tokens remembered."""

    def __init__(self, model: CharacterModel) -> None:
        self.model = model
        self.memory: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        found = self.memory.get(token)
        if found is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            core = token.strip(TRIM)
            # A mark at either end may be a letter in disguise.
            whole = token.strip(TRIM.replace("!", "").replace("(", ""))
            if is_hidden(core):
                read = restore(core, self.model)
            elif whole != core and core and is_hidden(whole) and not core.isalpha():
                read = restore(whole, self.model)
            elif may_hide(core):
                read = " ".join([core, *self.beside(core)])
            else:
                read = core
            found = self.memory[token] = tuple(LETTERS.findall(read))
        return found

    def beside(self, core: str) -> list[str]:
        """Words of the likeliest reading that differ; of known words, only those known as well."""
        plain, known = LETTERS.findall(core), self.model.words
        sure = all(word in known for word in plain)
        read = LETTERS.findall(restore(core, self.model))
        return [word for word in read if word not in plain and (word in known or not sure)]

    def spaced(self, lowered: str, worth: Callable[[str], bool] = lambda span: True) -> list[str]:
        return [
            word for span in SPACED.findall(lowered) if worth(span)
            for word in LETTERS.findall(restore(span.replace("\t", " "), self.model))
        ]

    def words(self, text: str | None) -> list[str]:
        lowered = (text or "").lower()
        found = [word for token in lowered.split() for word in self.token(token)]
        return found + self.spaced(lowered)

    def restored(self, text: str | None) -> str:
        """The text with its hidden spans read, in lower case."""
        lowered = SPACED.sub(
            lambda m: restore(m[0].replace("\t", " "), self.model), (text or "").lower()
        )

        def read(match):
            core = match[0].strip(TRIM)
            hidden = is_hidden(core) or may_hide(core) and core not in self.model.words
            return match[0].replace(core, restore(core, self.model)) if hidden else match[0]

        return re.sub(r"\S+", read, lowered)


def lowest_share(one: int, zero: int) -> float:
    """Lower end of Wilson's interval for the share of ``one``."""
    n, square = one + zero, ERRORS**2
    middle = one + square / 2
    spread = ERRORS * math.sqrt(one * zero / n + square / 4)
    return (middle - spread) / (n + square)


@dataclass(frozen=True)
class ToxicityModel:
    words: dict[str, float]  # the words that the character model learned from, weighted
    evidence: dict[str, float]  # log odds of label 1 for documents with the word
    weights: tuple[float, ...]  # summed log odds, ascending
    chances: tuple[float, ...]  # probability of label 1 from each of these on

    def chance(self, words: set[str]) -> float:
        """Probability of label 1 for a text with just these evidence words."""
        total = sum(self.evidence[word] for word in sorted(words))
        return self.chances[max(0, int(np.searchsorted(self.weights, total, side="right")) - 1)]


# Bounds between sums of log odds whose documents are counted together.
BOUNDS = (0.0, 0.7, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0)


def rising_chances(
    totals: np.ndarray, labels: np.ndarray, counts: np.ndarray
) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Probability of label 1 by sum of log odds: counted in bins, pooled until it never falls."""
    bins = np.searchsorted(BOUNDS, totals)
    pools: list[list[float]] = []  # ones, all, lowest total
    for one in np.unique(bins):
        at = bins == one
        pools.append(
            [counts[at & (labels == 1)].sum(), counts[at].sum(), totals[at].min()]
        )
        while len(pools) > 1 and pools[-1][0] * pools[-2][1] <= pools[-2][0] * pools[-1][1]:
            ones, n, _ = pools.pop()
            pools[-1][0] += ones
            pools[-1][1] += n
    return (
        tuple(float(lowest) for _, _, lowest in pools),
        tuple(float((ones + 0.5) / (n + 1.0)) for ones, n, _ in pools),
    )


# Letters that one look-alike may stand for are one class, named by the first. The mark for any vowel
# is left out here.
ANY_VOWEL = "*"
CLASSES = str.maketrans(
    {letter: letters[0] for letters in LOOKALIKE.values() if letters != LOOKALIKE[ANY_VOWEL] for letter in letters}
    | {mark: letters[0] for mark, letters in LOOKALIKE.items() if mark != ANY_VOWEL}
)
NO_LETTER, RUN = re.compile(r"[\W\d_]+"), re.compile(r"(.)\1+")
NO_LETTER_OR_BLANK = re.compile(r"[^\w ]+|[\d_]+")
VOWEL = re.compile(f"[{LOOKALIKE[ANY_VOWEL].translate(CLASSES)}]+")


def skeleton(span: str, vowels: bool = True) -> str:
    """What all readings of a span have in common: classes of letters, without runs or marks.

    A word of a reading is made of neighbouring characters of the span, with separators left out,
    look-alikes read as letters of their class and runs shortened. Its skeleton therefore lies in
    the span's; in that without vowels, if the span has marks for any vowel.
    """
    letters = NO_LETTER.sub("", span.translate(CLASSES))
    return RUN.sub(r"\1", letters if vowels else VOWEL.sub("", letters))


class Possible:
    """Whether some reading of a span may hold one of the given words."""

    def __init__(self, words: Iterable[str]) -> None:
        import ahocorasick

        words = list(words)
        self.found = {}
        for vowels in (True, False):
            skeletons = {skeleton(word, vowels) for word in words}
            if "" in skeletons or not skeletons:
                self.found[vowels] = bool(skeletons)
                continue
            self.found[vowels] = ahocorasick.Automaton()
            for one in skeletons:
                self.found[vowels].add_word(one, True)
            self.found[vowels].make_automaton()

    def __call__(self, span: str) -> bool:
        vowels = ANY_VOWEL not in span
        found = self.found[vowels]
        if isinstance(found, bool):
            return found
        return next(found.iter(skeleton(span, vowels)), None) is not None

    def among(self, spans: Iterable[str]) -> list[str]:
        """Those of some spans without white space that it says yes to."""
        marked = [span for span in spans if ANY_VOWEL in span]
        others = [span for span in spans if ANY_VOWEL not in span]
        found = self.found[True]
        if others and not isinstance(found, bool):
            # Nearly all say no: they are looked at in one go, with blanks that no skeleton has.
            letters = NO_LETTER_OR_BLANK.sub("", " ".join(others).translate(CLASSES))
            if next(found.iter(RUN.sub(r"\1", letters)), None) is None:
                others = []
        return [span for span in marked + others if self(span)]


class Finder:
    """Which of the given words a text holds. Only spans of which some reading may hold one are
    decoded, or all, with the same words found."""

    def __init__(self, reader: Reader, words: Iterable[str], decode_all: bool = False) -> None:
        self.reader, self.wanted = reader, frozenset(words)
        self.memory: dict[str, tuple[str, ...]] = {}
        self.possible = None if decode_all else Possible(self.wanted)

    def __call__(self, text: str | None) -> set[str]:
        lowered = (text or "").lower()
        tokens, memory, possible = set(lowered.split()), self.memory, self.possible
        if len(memory) >= REMEMBERED:
            memory.clear()
        new = tokens.difference(memory)
        memory.update(dict.fromkeys(new, ()))
        for token in new if possible is None else possible.among(new):
            memory[token] = tuple(w for w in self.reader.token(token) if w in self.wanted)
        found = {word for words in map(memory.__getitem__, tokens) for word in words}
        spaced = self.reader.spaced(lowered) if possible is None else self.reader.spaced(lowered, possible)
        return found.union(word for word in spaced if word in self.wanted)


def _plain_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label with a word as it is written; for each part those of label 0 where
    it stands between white space, so that every reading has it."""

    def counted() -> pa.RecordBatch:
        words = list(dict.fromkeys(word for count in counts for word in count))
        once_read = [not THRICE.search(word) for word in words]
        columns = [pa.array(list(map(count.get, words)), pa.int64()) for count in counts]
        columns[2:] = [pc.if_else(pa.array(once_read, pa.bool_()), column, 0) for column in columns[2:]]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(column.fill_null(0) for column in columns)],
            ["word", "zero", "one", *(f"sure_{part}" for part in range(PARTS))],
        )

    counts = [Counter() for _ in range(2 + PARTS)]
    for batch in batches:
        for one, text, part in zip(*(column.to_pylist() for column in batch.columns)):
            lowered = (text or "").lower()
            counts[one].update(set(LETTERS.findall(lowered)))
            if one == 0:
                counts[2 + part].update(filter(str.isalpha, set(lowered.split())))
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield counted()
                counts = [Counter() for _ in range(2 + PARTS)]
    yield counted()


def _words_reader(learned: dict[str, float]):
    """All restored words of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Reader(CharacterModel(learned)).words
        for batch in batches:
            for start in range(0, batch.num_rows, SENT):
                label, text, part = batch.slice(start, SENT).columns
                lists = pa.array(list(map(words, text.to_pylist())), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([label, part, lists], ["label", "part", "words"])

    return read


def _words_finder(learned: dict[str, float], wanted: Iterable[str]):
    """Documents with some of the wanted words, and which; others are left out."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Reader(CharacterModel(learned)), wanted)
        for batch in batches:
            label, text, part = batch.columns
            lists = pa.array([list(finder(value)) for value in text.to_pylist()], pa.list_(pa.string()))
            found = pa.RecordBatch.from_arrays([label, part, lists, text], ["label", "part", "words", "text"])
            yield found.filter(pc.greater(pc.list_value_length(lists), 0))

    return find


def _places(read: DataFrame) -> DataFrame:
    """``(word, near, part)``: every place of a word with the words on both its sides."""

    def beside(i: Column) -> Column:
        return F.coalesce(F.get("words", i), F.lit(""))

    placed = F.transform(
        "words", lambda word, i: F.struct(word.alias("word"), F.concat(beside(i - 1), F.lit(" "), beside(i + 1)).alias("near"))
    )
    return read.select("part", F.explode(placed).alias("place")).select("place.word", "place.near", "part")


# Without one part after the other, and last with all of them.
WITHOUT = (*range(PARTS), -1)


def _documents_with(read: DataFrame, out: str) -> DataFrame:
    """Documents with each word, without every part: ``out`` and the place in ``WITHOUT``."""
    return (
        read.select("part", F.explode(F.array_distinct("words")).alias("word"))
        .groupBy("word")
        .agg(*[F.count(F.when(F.col("part") != part, 1)).alias(f"{out}_{k}") for k, part in enumerate(WITHOUT)])
    )


def _neighbours_of(places: DataFrame, out: str) -> DataFrame:
    """Different neighbours of each word, without every part: those with another part than it."""
    near = places.groupBy("word", "near").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return near.groupBy("word").agg(
        *[
            F.count(F.when((F.col("low") != part) | (F.col("high") != part), 1)).alias(f"{out}_{k}")
            for k, part in enumerate(WITHOUT)
        ]
    )


def _pure(one: Column, zero: Column) -> Column:
    return (one >= NEIGHBOURS) & (one / (one + zero) >= PURITY)


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> ToxicityModel:
    """Learn from all documents with a label in ``labels`` (key, label 0/1), of which a key's largest
    counts.

    Copies of a document bring a word always in the same company; words are therefore counted by
    their different neighbours. Documents labelled 1 are read whole. A word that too many others
    must hold, as it stands there with a single reading, is ruled out first, so that those are read
    only where a reading may hold a word that is left, and whole only if it is still possible then.
    The driver gets sums, ``WORDS`` words, and
    words of label 1 with neighbours enough to be evidence.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    given = scratch.store(
        labels.select(F.col(key).alias("key"), F.col(label).alias("label"))
        .where("key is not null and label in (0, 1)")
        .groupBy("key").agg(F.max("label").cast("int").alias("label")),
        "given",
    )
    if given.where("label = 1").isEmpty():
        return ToxicityModel({}, {}, (0.0,), (0.0,))
    texts = scratch.store(
        documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .join(given, "key")
        .dropDuplicates(["key"])
        .select("label", "text", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int").alias("part")),
        "texts",
    )
    # Two numbers.
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if not n:
        return ToxicityModel({}, {}, (0.0,), (0.0,))
    weight = {one: 1.0 / max(1, n.get(one, 0)) for one in (0, 1)}
    sure = [f"sure_{part}" for part in range(PARTS)]
    schema = ", ".join(["word string", *(f"{name} bigint" for name in ("zero", "one", *sure))])
    plain = scratch.store(
        texts.mapInArrow(_plain_words, schema).groupBy("word")
        .agg(*[F.sum(name).alias(name) for name in ("zero", "one", *sure)]).where("zero + one > 1"),
        "plain_words",
    )
    balanced = F.col("zero") * weight[0] + F.col("one") * weight[1]
    learned = {
        row["word"]: row["weight"]
        for row in plain.select("word", balanced.alias("weight"))
        .orderBy(F.desc("weight"), "word").limit(WORDS).collect()
    }
    read_schema = "label int, part int, words array<string>"
    ones = scratch.store(texts.where("label = 1").mapInArrow(_words_reader(learned), read_schema), "ones")
    # Words that may pass, as far as the documents of label 0 are known without reading them.
    least_zero = [
        sum((F.coalesce(name, F.lit(0)) for other, name in enumerate(sure) if other != part), F.lit(0)) for part in WITHOUT
    ]
    maybe = scratch.store(
        _documents_with(ones, "one").where(F.col(f"one_{PARTS}") >= NEIGHBOURS)
        .join(plain.select("word", *sure), "word", "left")
        .withColumn("passes", F.array(*[_pure(F.col(f"one_{k}"), least_zero[k]) for k in range(len(WITHOUT))]))
        .where(F.exists("passes", lambda x: x)).drop(*sure),
        "maybe",
    )
    told = _neighbours_of(_places(ones).join(maybe.select("word"), "word"), "near_one").join(maybe, "word")
    enough = [F.col("passes")[k] & (F.col(f"near_one_{k}") >= NEIGHBOURS) for k in range(len(WITHOUT))]
    candidates = {row["word"]: row for row in told.where(F.greatest(*enough)).collect()}
    zeros = scratch.store(
        texts.where("label = 0").mapInArrow(_words_finder(learned, candidates), f"{read_schema}, text string"), "zeros"
    )
    with_zero = {row["word"]: row for row in _documents_with(zeros, "zero").collect()}

    def passes(word: str, k: int) -> bool:
        one, zero = candidates[word][f"one_{k}"], with_zero[word][f"zero_{k}"] if word in with_zero else 0
        return one >= NEIGHBOURS and one / (one + zero) >= PURITY

    # Of label 0, only documents with words that passed so far are read whole: words with few of them.
    few = [(word,) for word in candidates if any(passes(word, k) for k in range(len(WITHOUT)))]
    named = F.broadcast(spark.createDataFrame(few, "word string"))
    whole = zeros.where(F.exists("words", lambda word: word.isin([word for word, in few]))).select("label", "text", "part")
    near_zero = {
        row["word"]: row
        for row in _neighbours_of(
            _places(whole.mapInArrow(_words_reader(learned), read_schema)).join(named, "word"), "near_zero"
        ).collect()
    } if few else {}
    evidences: list[dict[str, float]] = [{} for _ in WITHOUT]
    for word, in few:
        for k, evidence in enumerate(evidences):
            one = candidates[word][f"near_one_{k}"]
            if one < NEIGHBOURS or not passes(word, k):
                continue
            share = lowest_share(one, near_zero[word][f"near_zero_{k}"] if word in near_zero else 0)
            odds = share / (1.0 - share)
            if odds >= PURITY / (1.0 - PURITY):
                evidence[word] = math.log(odds)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = []
            for part, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                evidence = evidences[part]
                totals.append(sum(evidence[w] for w in sorted(evidence.keys() & set(words))))
            bins = np.searchsorted(BOUNDS, np.array(totals, np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.float64()), pa.array(bins, pa.int32())],
                ["label", "total", "bin"],
            )

    # One row for each label and bin; documents of label 0 that are not kept have no evidence.
    points = (
        ones.unionByName(zeros.drop("text")).mapInArrow(summed, "label int, total double, bin int")
        .groupBy("label", "bin").agg(F.min("total").alias("total"), F.count("*").alias("n")).collect()
    )
    points = [(row["total"], row["label"], row["n"]) for row in points]
    unread = n.get(0, 0) - sum(count for _, one, count in points if one == 0)
    points += [(0.0, 0, unread)] if unread else []
    totals, which, counts = map(np.array, zip(*points))
    weights, chances = rising_chances(totals, which, counts)
    return ToxicityModel(learned, evidences[-1], weights, chances)


def toxicity_of(text: str | Column, model: ToxicityModel, decode_all: bool = False) -> Column:
    """Probability that a text deserves label 1, by the evidence words in it.

    Only spans of which some reading may hold such a word are decoded, or all, with the same scores.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(Reader(CharacterModel(model.words)), model.evidence, decode_all)
        for texts in batches:
            chances = (model.chance(finder(value)) for value in texts)
            yield pd.Series(np.fromiter(chances, np.float64, len(texts)))

    return score(text)


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 3,
    held_out: int = 1,
    limit: float = LIMIT,
) -> DataFrame:
    """``(key, held_out, score, predicted)`` for every row.

    Null and empty texts have the score of a text without evidence; without any label 1 to learn
    from, every score is 0. Labels other than 0 and 1, null keys and keys without a document teach
    nothing. Rows with a null key are scored. Repeated rows are returned each. Other columns are
    not read.
    """
    model = fit_toxicity(
        documents, labels.where(~in_fold(key, folds, held_out)), key, text, label
    )
    return documents.select(
        F.col(key).alias(key),
        in_fold(key, folds, held_out).alias("held_out"),
        toxicity_of(F.col(text), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= limit).cast("int"))
