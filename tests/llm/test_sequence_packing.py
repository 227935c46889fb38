import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foretoken.llm.sequence_packing import (
    cut_lengths,
    pack_documents,
    pattern_segments,
    shortest_pack_first,
    tokenizer_ids,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(PATH)


TEXTS = [
    "", " ", "a  b\n\n c\t", "It's we'll x'S 12345 ½ ²", "日本語 😀 é́", "a<|endoftext|>b", "\x00\x7f\xa0­",
    "Ünïcode ΑΒΓ привет “quoted” — dash… €", "x" * 500, "  　 x", "ͰͿ ԱԲ ꙮ",
]


def test_ids_are_the_tokenizers_own(own, documents):
    ids = tokenizer_ids(PATH)
    for text in TEXTS + [r.text for r in documents.limit(50).collect()]:
        assert ids(text) == own.encode(text, add_special_tokens=False).ids


def slow_worst_fit(lengths, capacity):
    packs = []
    for size in sorted(lengths, reverse=True):
        at = max(range(len(packs)), key=lambda i: capacity - sum(packs[i]), default=None)
        if at is not None and capacity - sum(packs[at]) >= size:
            packs[at].append(size)
        else:
            packs.append([size])
    return packs


@pytest.mark.parametrize("seed", range(6))
def test_packs_are_those_of_piece_by_piece_packing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 33, 300).tolist() + [7] * 200
    filled = Counter()
    for count, items in shortest_pack_first(Counter(lengths), 32):
        filled[sum(size * copies for size, copies in items)] += count
    # Equally empty packs may swap their contents.
    assert filled == Counter(map(sum, slow_worst_fit(lengths, 32)))


def test_segments_give_each_rank_one_place():
    lengths = np.random.default_rng(4).integers(1, 65, 2000).tolist()
    counts = Counter(lengths)
    segments = pattern_segments(shortest_pack_first(counts, 64))
    for size, n in counts.items():
        at = segments["length"] == size
        assert segments["rank"][at][0] == 0 and (np.diff(segments["rank"][at]) > 0).all()
        assert n > segments["rank"][at][-1]


def check(rows, texts, own, length=1024):
    """Every id in one piece, every sequence gapless; returns the share of padding."""
    by_text, by_sequence = {}, {}
    for r in rows:
        by_text.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_text) == {key for key, _ in texts}
    for key in by_text:
        same = [t for k, t in texts if k == key]
        want = Counter()
        for text in same:
            ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            start = 0
            for size in cut_lengths(len(ids), length):
                want[start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids)] += 1
                start += size
            assert start == len(ids)
        assert want == Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_text[key])
    filled = padded = 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for piece in sorted(pieces, key=lambda r: r.offset):
            assert piece.offset == at
            at += piece.length
        assert 0 < at <= length
        filled += at
        padded += 0 if at & (at - 1) == 0 else length - at
    return padded / (filled + padded)


def test_all_documents(documents, own):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    assert check(pack_documents(documents, PATH).collect(), texts, own) < 0.03


def test_odd_rows(odd_documents, no_documents, own):
    texts = [(r.doc_id, r.text) for r in odd_documents.collect()]
    check(pack_documents(odd_documents, PATH).collect(), texts, own)
    assert pack_documents(no_documents, PATH).collect() == []


def test_ranks_of_a_hot_length_are_salted(spark, own, monkeypatch):
    monkeypatch.setattr("foretoken.llm.common.RANK_ROWS", 8)
    texts = [(i, "same text") for i in range(300)] + [(300 + i, "x " * i) for i in range(60)]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    check(pack_documents(rows, PATH, length=64).collect(), texts, own, 64)
