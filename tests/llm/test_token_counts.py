import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, normalizers

from foretoken.llm.token_counts import Counter, Vocabulary, count_tokens, read_vocabulary


def library(vocabulary):
    """The same vocabulary in a tokenizer library."""
    scored = [*zip(vocabulary.pieces, vocabulary.scores)]
    made = Tokenizer(models.Unigram(scored, 0, vocabulary.byte_fallback))
    made.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return made


@pytest.fixture(scope="module")
def published():
    return read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


ODD = ["", " ", "a  b", "\n\n a\n", "日本語 テスト", "a\tb", "▁▁x ▁", "   ", "a \n b", "é́", "😀😀 x", "<0x41>"]


def test_published_vocabulary(published, documents):
    own, counter = library(published), Counter(published)
    assert counter.apart
    rng = random.Random(1)
    texts = ODD + [r.text for r in documents.limit(60).collect()]
    texts += ["".join(rng.choices("ab e\n.▁é日😀0<x>", k=rng.randint(0, 40))) for _ in range(500)]
    for text in texts:
        assert counter.of_text(text) == len(own.encode(text).ids), text


@pytest.mark.parametrize("whole", [True, False])
def test_ties_and_unknown_characters(whole):
    rng = random.Random(2)
    for _ in range(40):
        pieces = {"<unk>": 0.0}
        for _ in range(rng.randint(1, 12)):
            score = -rng.randint(1, 4) if whole else -rng.random()
            pieces["".join(rng.choices("ab▁c", k=rng.randint(1, 4)))] = float(score)
        vocabulary = Vocabulary(tuple(pieces), tuple(pieces.values()), False)
        own, counter = library(vocabulary), Counter(vocabulary)
        for _ in range(60):
            text = "".join(rng.choices("abc dx", k=rng.randint(1, 14)))
            assert counter.of_text(text) == len(own.encode(text).ids), (pieces, text)


def test_memory_starts_anew(published, monkeypatch):
    monkeypatch.setattr("foretoken.llm.token_counts.REMEMBERED", 2)
    counter = Counter(published)
    text = "one two three four five one two"
    assert counter.of_text(text) == counter.of_text(text) == Counter(published).of_segment("▁" + text.replace(" ", "▁"))


def test_odd_rows(odd_documents, no_documents, published):
    own = library(published)
    found = count_tokens(odd_documents, published).collect()
    want = [(r.doc_id, len(own.encode(r.text or "").ids)) for r in odd_documents.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)
    assert count_tokens(no_documents, published).collect() == []
