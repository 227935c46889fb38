"""Alignment against a plain walk over byte spans, and corpus counts against plain counters."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foretoken.llm.alignment import (
    align_documents,
    alignment_digests,
    byte_level_tokens,
    gallop,
    piece_tokens,
    ranks_of_ends,
)

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300)), st.lists(st.integers(-5, 310)), st.integers(-3, 300))
def test_galloping_finds_ranks(values, keys, start):
    longer, keys = np.array(sorted(values), np.int64), np.array(keys, np.int64)
    got = gallop(longer, keys, np.full(len(keys), start))
    assert got.tolist() == np.searchsorted(longer, keys).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 29)), st.sets(st.integers(1, 29))), max_size=6))
def test_ranks_over_several_texts(texts):
    a, b, at_a, at_b = [], [], [0], [0]
    for k, (one, other) in enumerate(texts):
        # Texts end together, as their bytes are the same.
        a += [30 * k + v for v in sorted(one | {30})]
        b += [30 * k + v for v in sorted(other | {30})]
        at_a.append(len(a))
        at_b.append(len(b))
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    below, common = ranks_of_ends(a, b, np.array(at_a), np.array(at_b))
    assert below.tolist() == np.searchsorted(b, a).tolist()
    assert common.tolist() == np.isin(a, b).tolist()


def walked(text, tools):
    """Ids, groups and links of one text, byte by byte."""
    a_tool, b_tool, a_bytes, b_bytes = tools
    if not text:
        return [], [], [], []
    a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
    raw = (" " + text).encode()
    if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
        return [], [], [], []
    spans = []
    for ids, spelled in ((a, a_bytes), (b, b_bytes)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(spelled[i]), i))
            at += len(spelled[i])
        spans.append(own)
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
    groups, begin = [], 0
    for end in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
        groups.append(tuple([i for _, e, i in own if begin < e <= end] for own in spans))
        begin = end
    return a, b, groups, links


@pytest.fixture(scope="module")
def tools():
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=B), byte_level_tokens(A)[1], piece_tokens(B)[1]


TEXTS = [
    "The cat sat.", "The cat sat.", None, "", " ", "a  b", "<|endoftext|> and <s> are plain text </s>",
    "naïve façade — 日本語 😀 zero\u0000byte", "ﬁ ligature", "x" * 3000 + " end", "\ttab\nline", "The dog sat on the mat.",
]


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_digests_like_plain_counting(spark, tools, block_bytes):
    rows = [(k, text) for k, text in enumerate(TEXTS)] + [(None, "The cat ran."), (0, "The cat sat.")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for name in ("block", "pair", "key", "n"):
        frame = frame.withColumn(name, frame["doc_id"])
    alignments = [walked(text, tools) for _, text in rows]
    counts = Counter(pair for *_, links in alignments for pair in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    want = []
    for (key, _), (a, b, groups, links) in zip(rows, alignments):
        shown = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        want.append((
            key, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    got = alignment_digests(frame, A, B, block_bytes=block_bytes)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    order = lambda r: (r[0] is None, str(r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert sum(n > 0 for _, n, *_ in want) > 6


def test_groups_as_spans(spark, tools):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for row in align_documents(frame, A, B).collect():
        a, b, groups, _ = walked(TEXTS[row.doc_id], tools)
        assert (row.a_ids, row.b_ids) == (a, b)
        cuts = list(zip([0, *row.a_ends], row.a_ends, [0, *row.b_ends], row.b_ends))
        assert [(row.a_ids[p:q], row.b_ids[r:s]) for p, q, r, s in cuts] == groups
        assert not row.byte_ends or row.byte_ends[-1] == len(TEXTS[row.doc_id].encode()) + 1


def test_no_documents(spark, no_documents, odd_documents):
    assert alignment_digests(no_documents, A, B).count() == 0
    assert alignment_digests(odd_documents, A, B).count() == odd_documents.count()
