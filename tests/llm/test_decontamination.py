import gc
import random
import weakref
from itertools import combinations

import numpy as np
import pytest

from foretoken.llm.decontamination import (
    Index,
    Searcher,
    drop_contaminated,
    find_contamination,
    greatest_loss,
    indexes,
    make_item,
    question_and_answer,
    shingles_of,
    words_of,
)

SF = "/root/testdata/sf0.01"


def test_parts():
    assert question_and_answer("What is it? A dog.") == (["what", "is", "it"], ["a", "dog"])
    assert question_and_answer("Who? Answer: the big dog") == (["who"], ["the", "big", "dog"])
    assert question_and_answer("one two three four") == (["one", "two", "three"], ["four"])
    assert question_and_answer("one") == ([], ["one"])
    assert make_item(1, " .. ") is None


def test_greatest_loss_covers_all_sets_of_absent_words():
    rng = random.Random(3)
    for n in (5, 7, 9):
        weights = [rng.random() for _ in range(n)]
        shingles = [set(range(i, i + 5)) for i in range(n - 4)]
        for lost in range(len(shingles) + 1):
            best = max(
                sum(weights[i] for i in absent)
                for k in range(n + 1)
                for absent in combinations(range(n), k)
                if sum(bool(s & set(absent)) for s in shingles) <= lost
            )
            assert greatest_loss(np.array(weights), len(shingles), lost) == pytest.approx(best)


def random_items(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 40))) + ". ok yes" for _ in range(n)]
    return [make_item(i, t) for i, t in enumerate(texts)], vocabulary


def test_search_retrieves_all_items_above_the_threshold():
    rng = random.Random(5)
    items, vocabulary = random_items(rng, 50)
    index = Index(items)
    for _ in range(200):
        terms = sorted({index.terms[w] for w in rng.choices(vocabulary, k=30) if w in index.terms})
        if rng.random() < 0.5:
            terms = sorted({*terms, *(index.terms[w] for w in rng.choice(index.items).words)})
        scores = np.zeros(len(index.items))
        for t in terms:
            held, weight = index.postings[t]
            scores[held] += weight
        found = dict(index.search(terms))
        assert {i for i, s in enumerate(scores) if s >= 1.0} <= set(found)
        assert found == pytest.approx({i: scores[i] for i in found}) and min(found.values(), default=1) > 0.999


def slow_find(texts, items, stride):
    found = set()
    for key, text in texts:
        words = words_of(text)
        for start in range(0, len(words), stride):
            seen = set(
                s for size in range(1, 6)
                for s in zip(*[words[start : start + 2 * stride][k:] for k in range(size)])
            )
            for item in items:
                asked, answered, whole = item.overlaps(seen)
                if whole >= 0.8 and min(asked, answered) >= 0.5:
                    found.add((key, item.key))
    return found


def test_edited_items_are_found_as_by_brute_force():
    rng = random.Random(7)
    items, vocabulary = random_items(rng, 30)
    index = Index(items)
    texts = []
    for key in range(150):
        words = rng.choices(vocabulary, k=rng.randint(0, 150))
        own = list(rng.choice(index.items).words)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = "new"
        at = rng.randint(0, len(words))
        texts.append((key, " ".join(words[:at] + own[rng.randint(0, 2) :] + words[at:])))
    searcher = Searcher(index)
    got = {(key, row[0]) for key, text in texts for row in searcher.find(text)}
    assert got == slow_find(texts, index.items, index.stride) and got


def test_all_documents(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in find_contamination(documents, benchmark).collect()}
    items = [make_item(r.item_id, r.text) for r in benchmark.collect()]
    holders = {}
    for item in items:
        for shingle in item.shingles:
            holders.setdefault(shingle, set()).add(item.key)
    texts = [
        (r.doc_id, r.text) for r in documents.collect()
        if any(s in holders for s in shingles_of(words_of(r.text)))
    ]
    assert got == slow_find(texts, items, Index(list(items)).stride) and got


def test_odd_rows(odd_documents, no_documents, spark):
    schema = "item_id bigint, text string, doc_id int, _found int"
    benchmark = spark.createDataFrame(
        [
            (1, "The cat sat on the mat and looked at the dog.", 1, 1),
            (1, "The cat sat on the mat and looked at the dog.", 1, 1),
            (2, None, 1, 1), (3, "", 1, 1), (None, "der Hund und die Katze sitzen auf der Matte", 1, 1),
            (4, "a", 1, 1), (5, "word " * 3000, 1, 1),
        ],
        schema,
    )
    found = [(r.doc_id, r.item_id) for r in find_contamination(odd_documents, benchmark).collect()]
    assert found.count((1, 1)) == 4 and found.count((2, 1)) == 2
    assert (None, None) in found and (8, None) in found and (10, 4) in found and (6, 5) in found
    assert not {3, 4, 5} & {k for k, _ in found}
    assert find_contamination(no_documents, benchmark).collect() == []
    assert find_contamination(odd_documents, benchmark.where("false")).collect() == []


def test_a_large_benchmark_is_searched_in_parts(odd_documents, spark, monkeypatch):
    monkeypatch.setattr("foretoken.llm.decontamination.INDEX_ITEMS", 2)
    texts = ["The cat sat on the mat and looked at the dog.", "der Hund und die Katze sitzen auf der Matte"]
    rows = [(i, texts[i % 2]) for i in range(7)]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in find_contamination(odd_documents, benchmark).collect()}
    assert {i for k, i in found if k == 2} == {0, 2, 4, 6}
    assert {i for k, i in found if k == 8} == {1, 3, 5}


def test_one_index_is_held_at_a_time(odd_documents, spark, monkeypatch):
    monkeypatch.setattr("foretoken.llm.decontamination.INDEX_ITEMS", 2)
    held, most = [], []

    def counted(*given):
        for index in indexes(*given):
            held.append(weakref.ref(index))
            gc.collect()
            most.append(sum(one() is not None for one in held))
            yield index
            del index

    monkeypatch.setattr("foretoken.llm.decontamination.indexes", counted)
    rows = [(i, f"the small grey cat number {i} sat on the old mat by the fire") for i in range(8)]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string")
    find_contamination(odd_documents, benchmark)
    assert len(most) > 2 and max(most) == 1


def test_contaminated_documents_go(odd_documents, no_documents, spark, monkeypatch):
    rows = [(1, "The cat sat on the mat and looked at the dog."), (2, "der Hund und die Katze sitzen auf der Matte")]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string")
    for size in (1024, 1):
        monkeypatch.setattr("foretoken.llm.decontamination.INDEX_ITEMS", size)
        kept = drop_contaminated(odd_documents, benchmark)
        assert kept.columns == odd_documents.columns
        left = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
        gone = {t for _, t in rows} | {"Der Hund und die Katze sitzen auf der Matte hier."}
        gone |= {"Der Hund und die Katze sitzen auf der Matte."}
        want = [(r.doc_id or -1, r.text or "") for r in odd_documents.collect() if r.text not in gone]
        assert left == sorted(want)
    assert drop_contaminated(no_documents, benchmark).collect() == []
    assert drop_contaminated(odd_documents, benchmark.where("false")).count() == odd_documents.count()


@pytest.mark.parametrize("mark", ["Answer:", "A:", "answer :", "A:the"])
def test_copies_of_marked_items(mark):
    question = "What is the name of the river that runs through the middle of the old city today?"
    item = f"{question} {mark} Seine"
    index = Index([make_item(4, item), make_item(5, "Which dog sat on the mat? A: the small brown one")])
    searcher = Searcher(index)
    around = " ".join(f"w{i}" for i in range(40))
    ((key, _, *overlaps),) = searcher.find(f"{around} {item} {around}")
    assert key == 4 and overlaps == [1.0, 1.0, 1.0]
    unmarked = f"{question} {mark.partition(':')[2]} Seine" if mark == "A:the" else f"{question} Seine"
    assert [row[0] for row in searcher.find(f"{around} {unmarked} {around}")] == [4]
    assert searcher.find(f"{around} {question} {around}") == []
