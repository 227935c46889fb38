"""Licence scans against a comparison of every notice with every place."""

import math
import re

import pytest

from foretoken.llm.licences import NOTICES, all_texts, find_notices, licence_labels, rare_places, word_weights

TEXTS = [
    "Released under the MIT License. And again, under the mit-license!",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "licensed under the gnu general public licence version 3",  # its phrase is not whole
    "Licensed under CC BY-NC 4.0; cc by nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction",
    "Permission is hereby granted, free of charge, to any person receiving a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit license the under", "undér the mit license", "İunder the mit license", None, "", "!!!", "the " * 50,
    "a b " * 2000 + "under the mit license" + " c d" * 500,
    "license version 2", "apache license version 2 apache license version 2",
]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def compared(texts):
    """Every text of the index at every place of every document."""
    held = [(words.split(), share) for words, share in all_texts(NOTICES)]
    docs = [words_of(t) for t in texts]
    weight = {
        w: math.log((len(docs) + 1) / (sum(w in d for d in docs) + 1)) + 0.01 for words, _ in held for w in words
    }
    out = []
    for doc in docs:
        places = []
        for n, (words, share) in enumerate(held):
            for start in range(-len(words) + 1, len(doc)):
                there = [0 <= start + i < len(doc) and doc[start + i] == w for i, w in enumerate(words)]
                got = sum(weight[w] for w, t in zip(words, there) if t) / sum(weight[w] for w in words)
                got = 1.0 if all(there) else min(got, 1 - 1e-9)
                if got >= share:
                    places.append((n, start, start + len(words), got))
        out.append([
            (n, start, end - start, got) for n, start, end, got in places if n < len(NOTICES)
            and all(
                any(" ".join(held[m][0]) == p and start <= s and e <= end for m, s, e, _ in places if m >= len(NOTICES))
                for p in NOTICES[n].phrases
            )
        ])
    return docs, out


@pytest.fixture(scope="module")
def frame(spark):
    made = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for name in ("words", "found", "n", "start", "key"):
        made = made.withColumn(name, made["doc_id"])
    return made


def test_like_comparing_everything(frame):
    docs, want = compared(TEXTS)
    for row in find_notices(frame).collect():
        assert row.n_words == len(docs[row.doc_id])
        got = sorted((x.notice, x.start, x.size, round(x.share, 9)) for x in row.found)
        assert got == sorted((n, s, e, round(g, 9)) for n, s, e, g in want[row.doc_id]), TEXTS[row.doc_id]


def test_labels(frame):
    told = {r.doc_id: r for r in licence_labels(find_notices(frame)).collect()}
    assert tuple(told[0])[1:7] == (11, 2, 1, 7, "mit", "mit") and told[0].score == 1.0
    assert (told[1].base_labels, told[1].first_word) == ("apache-2", 3)
    assert (told[2].base_labels, told[2].labels, told[2].n_base, told[2].first_word) == ("", "gpl-3", 0, None)
    assert (told[3].labels, told[3].score) == ("", 0.0)
    assert (told[4].n_base, told[4].first_word, told[4].last_word) == (2, 2, 7)
    assert told[5].labels == "mit" and told[5].n_base == 0
    assert told[6].labels == "mit" and 0.8 <= told[6].score < 1
    assert told[14].first_word == 4000 and told[14].n_words == 5004
    assert told[16].n_base == 2 and told[16].last_word == 4


def test_native(frame):
    plan = find_notices(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_every_match_has_rare_places(spark):
    weights = word_weights(spark.createDataFrame([("the license of the software",), ("the a to",)], "text string"))
    for words, share in all_texts(NOTICES):
        own = words.split()
        places, total = rare_places(own, share, weights), sum(weights[w] for w in own)
        kept = sum(weights[own[i]] for i in places) - max(weights[own[i]] for i in places)
        assert len(places) == len(own) or kept > (1 - share) * total


def test_odd_documents(spark, odd_documents, no_documents):
    assert licence_labels(find_notices(odd_documents)).count() == odd_documents.count()
    assert licence_labels(find_notices(no_documents)).count() == 0
