import numpy as np
import pytest

from foretoken.llm.language import (
    LanguageModel,
    Scorer,
    fit_languages,
    grams_of,
    identify_languages,
    words_of,
)


def test_words():
    assert words_of("L'Été, 3x ²") == ["l", "été", "x", "²"]
    assert words_of("² 12 _") == [] and words_of(None) == [] and words_of("") == []
    assert grams_of("ab", 3) == [" ab", "ab "]


def model_of(words, grams):
    sizes = [{} for _ in range(5)]
    scores = [[] for _ in range(5)]
    for gram, row in grams.items():
        sizes[len(gram) - 1][gram] = len(scores[len(gram) - 1])
        scores[len(gram) - 1].append(row)
    return LanguageModel(
        ("de", "en"),
        np.log([0.5, 0.5]),
        {w: i for i, w in enumerate(words)},
        np.array(list(words.values())).reshape(-1, 2),
        tuple(sizes),
        tuple(np.array(s).reshape(-1, 2) for s in scores),
    )


def test_known_words_go_first_and_grams_back_off():
    model = model_of({"the": [-9.0, -1.0]}, {"th": [-1.0, -5.0], "t": [-3.0, -3.0], "sch": [-1.0, -8.0]})
    scorer = Scorer(model)
    assert scorer.predict("the")[0] == "en"  # the word, not its grams
    assert scorer.predict("thx")[0] == "de"  # "th" is the longest gram that is known
    assert scorer.unseen("schth").tolist() == [-1.0, -8.0]  # "sch" hides "th"
    assert scorer.unseen("qqq").tolist() == [0.0, 0.0]
    language, score = scorer.predict("qqq")
    assert (language, score) == ("de", 0.5)  # a tie goes to the first in order
    assert scorer.predict("12")[0] == "und" and scorer.predict(None) == ("und", 0.0)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr("foretoken.llm.language.REMEMBERED", 3)
    scorer = Scorer(model_of({"the": [-9.0, -1.0]}, {"t": [-3.0, -3.0]}))
    first = [scorer.predict(f"the w{'x' * i}") for i in range(9)]
    assert first == [scorer.predict(f"the w{'x' * i}") for i in range(9)]


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == documents.count() and held
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_the_label_of_a_row_is_no_input(documents, spark):
    from pyspark.sql import functions as F

    from foretoken.llm.common import in_fold

    hidden = documents.withColumn("lang", F.when(in_fold("doc_id", 4, 2), "xx").otherwise(F.col("lang")))
    one = sorted(identify_languages(documents).collect())
    assert one == sorted(identify_languages(hidden.withColumn("source", F.lit("s"))).collect())


def test_odd_rows(odd_documents):
    found = identify_languages(odd_documents).collect()
    assert len(found) == odd_documents.count()
    by = {r.doc_id: r for r in found}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (3, 4, 5, 7))
    assert {r.lang_pred for r in found} <= {"und", "en", "de", "fr"}


def test_no_rows(no_documents, odd_documents):
    assert identify_languages(no_documents).collect() == []
    unlabelled = odd_documents.where("lang is null")
    assert {r.lang_pred for r in identify_languages(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("sample", [1, 10])
def test_the_sample_is_bounded(documents, sample):
    model = fit_languages(documents, sample=sample, words=50, grams=20)
    assert len(model.words) <= 50 and all(len(g) <= 20 for g in model.grams)
