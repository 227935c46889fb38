import pytest

from foretoken.llm.toxicity import (
    CharacterModel,
    Possible,
    Reader,
    fit_toxicity,
    is_hidden,
    lattice,
    lowest_share,
    restore,
    rising_chances,
    score_toxicity,
    skeleton,
    toxicity_of,
)

import math

import numpy as np

SF = "/root/testdata/sf0.001"
WORDS = {"stupid": 5.0, "idiot": 5.0, "the": 9.0, "loser": 4.0, "dog": 3.0, "is": 6.0, "a": 5.0, "hello": 4.0}


@pytest.fixture(scope="module")
def model():
    return CharacterModel(WORDS)


def slow_restore(span, model):
    """The best of all paths of the lattice."""
    arcs = lattice(span)
    best = (-1e300, "")

    def walk(at, text, score):
        nonlocal best
        if at == len(span):
            tail = (" " + text)[-(model.order - 1) :]
            if not tail.endswith(" "):
                score += model.log_chance(tail, " ")
            if score > best[0]:
                best = (score, " ".join(text.split()))
            return
        for after, chars, cost in arcs[at]:
            new, total = text, score + cost
            for char in chars:
                if char == " " and (" " + new).endswith(" "):
                    continue
                total += model.log_chance((" " + new)[-(model.order - 1) :], char)
                new += char
            walk(after, new, total)

    walk(0, "", 0.0)
    return best[1]


@pytest.mark.parametrize(
    "span, word",
    [
        ("1d10t", "idiot"), ("stuuupid", "stupid"), ("s t u p i d", "stupid"), ("$tup1d", "stupid"),
        ("l-o-s-e-r", "loser"), ("id!ot", "idiot"), ("heeello", "hello"), ("i d i 0 t", "idiot"),
    ],
)
def test_hidden_words_are_restored(model, span, word):
    assert restore(span, model) == word == slow_restore(span, model)


@pytest.mark.parametrize("span", ["a b", "0", "xx1", "do@g", "th3 is"])
def test_viterbi_finds_the_best_path(model, span):
    assert restore(span, model) == slow_restore(span, model)


def test_what_is_hidden():
    assert all(map(is_hidden, ["1d10t", "stuuupid", "s.t.u.p.i.d", "$tup1d"]))
    assert not any(map(is_hidden, ["hello", "108.51.216.133", "2024", "123", "a", "e.g"]))


def test_texts(model):
    reader = Reader(model)
    assert "idiot" in reader.words("You 1D10T!") and "stupid" in reader.words("so s t u p i d\nhe")
    assert reader.restored("the $tup1d dog, a l o s e r") == "the stupid dog, a loser"
    assert reader.words("The dog.") == ["the", "dog"]
    assert reader.words(None) == [] == reader.words("")


@pytest.mark.parametrize(
    "token, word",
    [
        ("p47h371c", "pathetic"), ("w0r7h1355", "worthless"), ("$h!7", "shit"), ("$-t-u-p-i-d", "stupid"),
        ("stu-pid", "stupid"), ("iidiioott", "idiot"), ("Stupiid!", "stupid"),
    ],
)
def test_other_spellings_are_read(token, word):
    reader = Reader(CharacterModel({**WORDS, "pathetic": 3.0, "worthless": 3.0, "shit": 3.0}))
    assert word in reader.words(f"so {token} is")


def test_plain_words_stay(model):
    reader = Reader(CharacterModel({**WORDS, "ass": 1.0, "as": 9.0, "worthless": 3.0}))
    assert reader.words("hello worthless dog") == ["hello", "worthless", "dog"]
    assert "ass" in reader.words("ass") and {"the", "dog"} <= set(reader.words("the-dog"))
    assert reader.restored("a worthless iidiioott") == "a worthless idiot"


def test_chances_never_fall():
    weights, chances = rising_chances(
        np.array([0.0, 0.0, 1.2, 2.2, 3.2, 5.5]), np.array([0, 1, 0, 1, 0, 1]), np.ones(6)
    )
    assert list(chances) == sorted(chances) and list(weights) == sorted(weights)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = score_toxicity(documents, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in found if r.toxic == 1]
    clean = [r for r in found if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.005 * len(clean)
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found)


def test_odd_rows(odd_documents, no_documents, spark):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (99, 1), (8, 5)], "doc_id bigint, toxic int"
    )
    found = score_toxicity(odd_documents, labels).collect()
    assert len(found) == odd_documents.count() and all(0 <= r.score <= 1 for r in found)
    assert score_toxicity(no_documents, labels).collect() == []
    # A label without its document, and too few labels to set any apart.
    for few in (labels.where("doc_id = 99"), labels.where("doc_id = 1"), labels.where("doc_id <= 2")):
        found = score_toxicity(odd_documents, few).collect()
        assert len(found) == odd_documents.count() and all(0 <= r.score <= 1 for r in found)
    nothing = score_toxicity(odd_documents, labels.where("false")).collect()
    assert {r.score for r in nothing} == {0.0}


def test_scores_do_not_depend_on_what_is_decoded(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_toxicity(documents, labels)
    word = max(model.evidence, key=len)
    written = [
        word, "-".join(word), " ".join(word), word[0] + word, word.replace("o", "0").replace("i", "1"),
        word.replace("e", "3") + "!", f"x{word}", "*".join(word), word.replace("i", "|").replace("s", "$"),
    ]
    texts = documents.select("text").unionByName(spark.createDataFrame([(t,) for t in written], "text string"))
    scored = texts.select(toxicity_of("text", model).alias("a"), toxicity_of("text", model, True).alias("b"))
    assert scored.count() > 200 and scored.where("a <> b").count() == 0


@pytest.mark.parametrize(
    "span", ["st.u-p1d", "sssttuupid", "$tup|d", "ab0c", "l1l", "x-stupid9", "st*p*d", "*stu*pid*"]
)
def test_readings_keep_their_skeleton(span):
    model = CharacterModel({"stupid": 1.0, "ill": 1.0, "aboc": 1.0, "lil": 1.0})
    for read in restore(span, model).split():
        assert skeleton(read, "*" not in span) in skeleton(span, "*" not in span)


def test_the_model_is_fitted_on_all_labelled_documents(spark):
    def name(head, i):
        return head + "".join(chr(97 + int(c)) for c in str(i))

    # Words of which 40 documents of 10,000 of label 1, or two of 10,000 of label 0, have each.
    evil, rare = [name("zorb", i) for i in range(12)], [name("quib", i) for i in range(40)]
    docs = [(i, 1, f"plain {name('left', i)} {evil[i // 40] if i < 480 else 'plain'} {name('right', i)}") for i in range(10000)]
    docs += [(10000 + i, 0, f"plain words {rare[i // 2] if i < 80 else 'here'} {name('left', i)}") for i in range(10000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, toxic int, text string")
    model = fit_toxicity(frame.drop("toxic"), frame.drop("text"))
    share = lowest_share(40, 0)
    assert {word: model.evidence.get(word) for word in evil} == dict.fromkeys(evil, math.log(share / (1 - share)))
    assert {word: model.words.get(word) for word in rare} == dict.fromkeys(rare, 2 * (1.0 / 10000))
    # 9,520 documents of label 1 and all of label 0 have no evidence.
    assert model.chances[0] == (9520 + 0.5) / (19520 + 1.0)


def test_possible_words_among_many():
    possible = Possible(["stupid", "idiot"])
    spans = ["$tup1d", "st*p*d", "st.u-p1d", "stup", "id", "idiot", "the", "1d", "10t", "*", "x9"]
    assert sorted(possible.among(spans)) == sorted(filter(possible, spans))
    assert possible.among(["stup", "id", "the"]) == [] == possible.among([])
