import math
import random
import tracemalloc
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from foretoken.llm import language_model
from foretoken.llm.language_model import language_model_scores


def tokens_of(text):
    lowered = (text or "").encode().lower().split()
    return [*lowered, "end"]


def slow_scores(rows, order, mu):
    """Recursive interpolation, text by text."""
    trained = [t for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 10 != 0]
    counts = Counter()
    for text in trained:
        words = ["start", *tokens_of(text)]
        for i in range(len(words)):
            for n in range(1, order + 1):
                if i >= n - 1:
                    counts[tuple(words[i - n + 1 : i + 1])] += 1
    single = {k: v for k, v in counts.items() if len(k) == 1 and k != ("start",)}
    n, v = sum(single.values()), len(single)

    def chance(history, word):
        if not history:
            return (single.get((word,), 0) + 0.1) / (n + 0.1 * (v + 1))
        lower = chance(history[1:], word)
        seen = counts.get(history, 0)
        return (counts.get((*history, word), 0) + mu * lower) / (seen + mu) if seen else lower

    out = []
    for key, text in rows:
        words = ["start", *tokens_of(text)]
        score = sum(
            math.log10(chance(tuple(words[max(0, i - order + 1) : i]), words[i]))
            for i in range(1, len(words))
        )
        base = sum(math.log10(chance((), w)) for w in words[1:])
        known = sum((w,) in single for w in words[1:])
        out.append((key, len(words) - 1, known, n, base, score))
    return out


def same(found, want):
    assert len(found) == len(want)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    for got, expected in zip(sorted(found, key=order), sorted(want, key=order)):
        assert got[:4] == expected[:4]
        assert got[4:] == pytest.approx(expected[4:], rel=1e-9)


def rows_of(frame, **options):
    return [
        (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        for r in language_model_scores(frame, **options).collect()
    ]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_a_recursion(documents, order, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.limit(60).collect()]
    part = documents.sparkSession.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    # Lanes that are cut often.
    monkeypatch.setattr("foretoken.llm.language_model.LANE", 16)
    monkeypatch.setattr("foretoken.llm.language_model.BLOCK_BYTES", 20_000)
    same(rows_of(part, order=order, mu=7.0), slow_scores(rows, order, 7.0))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_parts_that_end_inside_of_texts(documents, order, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.limit(30).collect()]
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "a b " * 40)]
    part = documents.sparkSession.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    monkeypatch.setattr("foretoken.llm.language_model.LANE", 5)
    monkeypatch.setattr("foretoken.llm.language_model.PART_TOKENS", 23)
    same(rows_of(part, order=order, mu=7.0), slow_scores(rows, order, 7.0))


def test_a_block_is_scored_in_little_memory(monkeypatch):
    class OneTask:
        @classmethod
        def get(cls):
            return cls

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(language_model, "TaskContext", OneTask)
    draw = random.Random(1)
    texts = [" ".join(f"w{int(9 ** (5 * draw.random()))}" for _ in range(n)) for n in [300_000, *[700] * 700]]
    few = range(len(texts))
    rows = pa.table([few, texts, [True] * len(few), [False] * len(few)], names=["key", "text", "trained", "out"])
    (block,) = language_model.make_blocks(iter(rows.to_batches()))
    sent = pa.Table.from_batches(language_model.sender(2, 8)(iter([block])))
    told = [sent.filter(pa.compute.equal(sent["bucket"], b)) for b in range(256)]
    sums = pa.concat_tables([language_model.add_up(t) for t in told if t.num_rows])
    n, v = (sum(sums.column(c).to_pylist()) for c in "nv")
    score = language_model.scorer(2, 8, n, v, 30.0)
    block, sums = pa.Table.from_batches([block]), sums.select(["block", "level", "bucket", "totals"])
    del rows, sent, told
    tracemalloc.start()
    scored = score(block, sums)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored.column("n_tokens").to_pylist() == [len(t.split()) + 1 for t in texts]
    # 790,000 tokens: 93 MB; it was 156 MB with the automaton of all of them at a time.
    assert peak < 120 << 20, f"{peak >> 20} MB"


def test_odd_rows(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    same(rows_of(odd_documents, mu=5.0), slow_scores(rows, 2, 5.0))


def test_no_rows(no_documents):
    assert rows_of(no_documents) == []


def test_nothing_to_learn_from(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    frame = spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")
    (row,) = language_model_scores(frame).collect()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0
    assert row.score == pytest.approx(row.base_score) == pytest.approx(0.0)


def test_chances_of_all_next_words_sum_to_one(spark):
    frame = spark.createDataFrame(
        [(1, "a b a c"), (2, "b a"), (3, "a"), (4, "b"), (5, "c"), (6, ""), (7, "z")],
        "doc_id bigint, text string",
    ).where("doc_id <> 7")
    # Texts of one more word after the same start: P(text + word + end) / ...; sum over the words.
    extra = spark.createDataFrame([(None, w) for w in ["a", "b", "c", "", "new"]], frame.schema)
    scored = language_model_scores(frame.union(extra), mu=3.0).where("doc_id is null").collect()
    rows = [(k, t) for k, t in [(1, "a b a c"), (2, "b a"), (3, "a"), (4, "b"), (5, "c"), (6, "")]]
    want = {r[5] for r in slow_scores(rows + [(None, w) for w in ["a", "b", "c", "", "new"]], 2, 3.0)[6:]}
    assert {round(r.score, 9) for r in scored} == {round(w, 9) for w in want}
