"""Collocations against plain counting, with every way of dealing out the runs."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from foretoken.llm.collocations import _edge_maker, mine_collocations, unary_paths
from foretoken.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        scored = []
        for phrase, a in f.items():
            words = phrase.split(" ")
            if len(words) < 2 or a < least:
                continue
            longer = [
                other for other, n in f.items()
                if n >= least and len(other.split(" ")) > len(words) and f" {phrase} " in f" {other} "
            ]
            if any(100 * f[other] >= 80 * a for other in longer):
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((2000000 * a // (left + right), k, left, right))
            score, _, left, right = min(cuts)
            scored.append((-score, -a, phrase.encode(), phrase, a, left, right, score))
        for rank, (*_, phrase, a, left, right, score) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase, a, left, right, totals[lang], score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    words = ["a", "B", "é", "ÀX", "d e", "f" * 90, "g", "h"]
    fixed = ["a b g h a", "g h", "x y z x y z x y z x y z", "one two three four five six seven"]
    out = []
    for k in range(240):
        text = "".join(
            pick.choice(fixed) if pick.random() < 0.3
            else pick.choice(words) + pick.choice([" ", "  ", "\t", ". ", ",", "\n", " "])
            for _ in range(pick.randrange(30))
        )
        out.append((pick.choice(["en", "de", None, "", "x y", "="]), text))
    return out + [(None, None), ("en", ""), ("en", " \t\n ")] + out[:20]


@pytest.mark.parametrize(
    "options", [{}, {"chunk_bytes": 300, "part_bytes": 100}, {"chunk_bytes": 300, "split_rows": 3}]
)
def test_like_plain_counting(spark, rows, options):
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for name in ("id", "phrase", "f", "part"):
        frame = frame.withColumn(name, frame["text"])
    got = mine_collocations(frame, 5, 40, **options)
    want = plain(rows, 5, 40)
    assert sorted(map(tuple, got.collect())) == want
    assert len({r[0] for r in want}) == 6 and max(len(r[2].split(" ")) for r in want) == 4


def test_unary_paths(spark):
    # A chain of five nodes, a branch at its end, a ring of three and a node with itself.
    edges = [(1, 2, 9), (2, 3, 8), (3, 4, 7), (4, 5, 6), (5, 6, 5), (5, 7, 4), (10, 11, 3), (11, 12, 3),
             (12, 10, 3), (20, 20, 2), (30, 31, 1)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint, f bigint")
    got = unary_paths(frame, Scratch(spark)).collect()
    assert sorted((r.nodes, r.inner) for r in got) == [([1, 2, 3, 4, 5], [9, 8, 7, 6]), ([30, 31], [1])]


def test_odd_documents(spark, odd_documents, no_documents):
    assert mine_collocations(no_documents, 2).collect() == []
    found = mine_collocations(odd_documents, 2).collect()
    assert {r.lang for r in found} == {"en", "de"}
    assert all(r.rank >= 1 and 0 < r.score <= 1000000 and r.a >= 2 for r in found)


def test_memory_of_a_chunk():
    # Sorting all runs of a chunk at once took 154 bytes a place.
    pick = random.Random(5)
    texts = [" ".join(str(pick.randrange(3000)) for _ in range(1000)).encode() for _ in range(200)]
    batch = pa.record_batch([pa.array(["en"] * 200), pa.array(texts, pa.binary())], ["lang", "text"])
    tracemalloc.start()
    n = sum(sum(rows.column("n").to_pylist()) for rows in _edge_maker(64, 1 << 30)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 199000 and peak < 100 * n
