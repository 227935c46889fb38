"""Licence notices in texts, found through a positional index of their rarest words.

Everything happens inside a row, in expressions: a text's words that the index knows give, for each
place where a notice has that word, the word at which the notice would begin. Beginnings that rare
words agree on are held against the whole notice; its mandatory phrases must stand inside.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of a notice's weight that must stand at its places.
SHARE = 0.8
# Rare words that must agree on where a notice begins, if it has as many words.
AGREEING = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Notice:
    """Words that tell of a licence. ``share`` is the part of their weight that must be there; 1 asks
    for every word. ``phrases`` must stand inside, word for word; ``base`` marks plain phrases."""

    label: str
    words: str
    share: float = SHARE
    phrases: tuple[str, ...] = ()
    base: bool = False


# Plain phrases, and notices as their licences word them.
NOTICES = (
    Notice("mit", "under the mit license", 1, base=True),
    Notice("apache-2", "apache license version 2", 1, base=True),
    Notice("cc-by-nc", "cc by nc", 1, base=True),
    Notice("gpl-3", "licensed under the gnu general public license version 3",
           phrases=("gnu general public license version 3",)),
    Notice("gpl-2", "licensed under the gnu general public license version 2",
           phrases=("gnu general public license version 2",)),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms "
           "of the gnu general public license as published by the free software foundation",
           phrases=("gnu general public license", "free software foundation")),
    Notice("lgpl", "this library is free software you can redistribute it and or modify it under the terms "
           "of the gnu lesser general public license as published by the free software foundation",
           phrases=("gnu lesser general public license",)),
    Notice("agpl", "licensed under the gnu affero general public license version 3",
           phrases=("gnu affero general public license",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
           "software and associated documentation files the software to deal in the software without restriction",
           phrases=("permission is hereby granted free of charge", "without restriction")),
    Notice("apache-2", "licensed under the apache license version 2 0 the license you may not use this file "
           "except in compliance with the license",
           phrases=("apache license version 2",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are "
           "permitted provided that the following conditions are met",
           phrases=("redistribution and use in source and binary forms",)),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or "
           "without fee is hereby granted",
           phrases=("with or without fee is hereby granted",)),
    Notice("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
           phrases=("mozilla public license v 2 0",)),
    Notice("cc-by", "licensed under a creative commons attribution 4 0 international license",
           phrases=("creative commons attribution 4 0",)),
    Notice("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
           phrases=("creative commons attribution noncommercial",)),
    Notice("cc0", "to the extent possible under law the author has waived all copyright and related or "
           "neighboring rights to this work",
           phrases=("waived all copyright and related or neighboring rights",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain",
           phrases=("free and unencumbered software",)),
)


def text_words(text: Column) -> Column:
    """The words of a text, A to Z in lower case; none of a null."""
    given = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_extract_all(F.translate(given, UPPER, LOWER), F.lit(WORD), F.lit(0))


def all_texts(notices: Sequence[Notice]) -> list[tuple[str, float]]:
    """What the index holds: the notices, then their different mandatory phrases, which must be whole."""
    phrases = dict.fromkeys(p for n in notices for p in n.phrases)
    return [*((n.words, n.share) for n in notices), *((p, 1) for p in phrases)]


def word_weights(documents: DataFrame, notices: Sequence[Notice] = NOTICES, text: str = "text") -> dict[str, float]:
    """Weight of every word of the notices, by how few of all texts have it.

    The driver gets one number for each different word of the notices.
    """
    known = sorted({w for words, _ in all_texts(notices) for w in words.split()})
    held = documents.select(F.array_intersect(text_words(F.col(text)), F.lit(known)).alias("held"))
    found = held.agg(
        F.count("*").alias("n"), *[F.count_if(F.array_contains("held", w)).alias(f"w{i}") for i, w in enumerate(known)]
    ).first()
    return {w: log((found.n + 1) / (found[f"w{i}"] + 1)) + 0.01 for i, w in enumerate(known)}


def rare_places(words: list[str], share: float, weights: dict[str, float]) -> list[int]:
    """The places of a notice's rarest words that the index needs.

    A match lacks at most ``1 - share`` of the weight. Places are taken, rarest word first, until all
    of them but the heaviest weigh more than that: a match then has ``AGREEING`` of them at least.
    """
    order = sorted(range(len(words)), key=lambda i: (-weights[words[i]], i))
    spare = (1 - share) * sum(weights[w] for w in words)
    taken = 0.0
    for n, i in enumerate(order, 1):
        taken += weights[words[i]]
        if n >= AGREEING and taken - weights[words[order[0]]] > spare:
            return order[:n]
    return order


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_notices(
    documents: DataFrame,
    notices: Sequence[Notice] = NOTICES,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, n_words, found)``: every place of every notice in every text.

    ``found`` lists ``(notice, label, base, start, size, share)``: where the notice's first word
    stands, or would stand, counted from 0, how many words it has, and the share of its weight that
    is there. Words are weighted over all texts, which takes one pass before; nothing is shuffled but
    the counts of the notices' words. Null texts are empty, null and repeated keys each give a row,
    long texts are read whole. Other columns are not read. The index is part of the plan, so the
    notices must be a list for people to read, not a table.
    """
    weights = word_weights(documents, notices, text)
    held = all_texts(notices)
    number = {words: i for i, (words, _) in enumerate(held) if i >= len(notices)}
    split = [words.split() for words, _ in held]
    places: dict[str, list[tuple[int, int]]] = {}
    for nth, (words, (_, share)) in enumerate(zip(split, held)):
        for i in rare_places(words, share, weights):
            places.setdefault(words[i], []).append((nth, i))
    index = F.create_map(*[
        c for word, at in sorted(places.items())
        for c in (F.lit(word), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n, i in at]))
    ])
    texts = F.array(*[F.lit(words) for words in split])
    weighed = F.array(*[F.lit([weights[w] for w in words]) for words in split])
    needed = F.lit([min(AGREEING, len(words)) for words in split])
    least = F.lit([float(share) for _, share in held])
    inside = F.array(*[
        F.lit([number[p] for p in n.phrases]) if n.phrases else F.array().cast("array<int>") for n in notices
    ])

    def beginnings(words: Column) -> Column:
        """Where notices would begin by each rare word of the text, as (notice, beginning)."""
        spots = F.array_compact(
            F.transform(words, lambda w, i: F.when(w.isin(list(places)), F.struct(w.alias("w"), i.alias("at"))))
        )
        return F.flatten(
            F.transform(
                spots,
                lambda s: F.transform(
                    F.element_at(index, s["w"]),
                    lambda p: F.struct(p["n"].alias("n"), (s["at"] - p["i"]).alias("start")),
                ),
            )
        )

    def agreed(begun: Column) -> Column:
        """Beginnings that as many rare words share as a match has at least."""
        return _let(
            F.array_sort(begun),
            lambda s: F.array_distinct(
                F.filter(s, lambda x, i: x == F.get(s, i + F.get(needed, x["n"]) - 1))
            ),
        )

    def weighed_at(words: Column, place: Column) -> Column:
        own, each = F.get(texts, place["n"]), F.get(weighed, place["n"])
        there = F.transform(
            own, lambda w, i: F.when(F.get(words, place["start"] + i) == w, F.get(each, i)).otherwise(0.0)
        )
        total = F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
        lacking = F.exists(there, lambda x: x == 0.0)
        share = F.aggregate(there, F.lit(0.0), lambda a, b: a + b) / total
        return F.struct(
            place["n"].alias("n"),
            place["start"].alias("start"),
            F.size(own).alias("size"),
            F.when(lacking, F.least(share, F.lit(1 - 1e-9))).otherwise(1.0).alias("share"),
        )

    def verified(found: Column) -> Column:
        """Notices of enough weight whose mandatory phrases all stand inside them."""
        enough = F.filter(found, lambda x: x["share"] >= F.get(least, x["n"]))
        return _let(
            enough,
            lambda all_found: F.filter(
                all_found,
                lambda x: (x["n"] < len(notices))
                & F.forall(
                    F.get(inside, x["n"]),
                    lambda phrase: F.exists(
                        all_found,
                        lambda y: (y["n"] == phrase)
                        & (y["start"] >= x["start"])
                        & (y["start"] + y["size"] <= x["start"] + x["size"]),
                    ),
                ),
            ),
        )

    labels = F.lit([n.label for n in notices])
    base = F.lit([n.base for n in notices])

    def described(words: Column) -> Column:
        weighed_places = F.transform(agreed(beginnings(words)), lambda p: weighed_at(words, p))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.transform(
                verified(weighed_places),
                lambda x: F.struct(
                    x["n"].alias("notice"),
                    F.get(labels, x["n"]).alias("label"),
                    F.get(base, x["n"]).alias("base"),
                    x["start"].alias("start"),
                    x["size"].alias("size"),
                    x["share"].alias("share"),
                ),
            ).alias("found"),
        )

    scanned = documents.select(
        F.col(key).alias("key"), _let(text_words(F.col(text)), described).alias("scan")
    )
    return scanned.select(F.col("key").alias(key), "scan.n_words", "scan.found")


def licence_labels(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Places and labels of each text, from :func:`find_notices`: of the plain phrases, and of all."""

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"].cast("bigint"))
    best = F.array_max(F.transform("found", lambda x: x["share"]))
    return found.select(
        key,
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        (F.floor(F.coalesce(best, F.lit(0.0)) * 1e6 + 0.5) / 1e6).alias("score"),
    )
