from itertools import combinations

import numpy as np
import pytest
import xxhash

from foretoken.llm.common import Scratch
from foretoken.llm.components import connected_components
from foretoken.llm.simhash import (
    byte_sets,
    drop_near_duplicates,
    fingerprint,
    near_links,
    posting_links,
    simhash_components,
)


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42)
        for i in range(len(words) - size + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(keys, fps, bits=4):
    label = {i: i for i in range(len(keys))}
    changed = True
    while changed:
        changed = False
        for i, j in combinations(range(len(keys)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= bits and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
                changed = True
    least = {}
    for i, key in enumerate(keys):
        if key is not None:
            least[label[i]] = min(key, least.get(label[i], key))
    return [least.get(label[i]) for i in range(len(keys))]


@pytest.mark.parametrize(
    "text", [None, "", " \n", "One", "one two THREE", "a b c d e f g", "É É é x y z\x0bq " * 9]
)
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_any_four_shared_bytes_share_a_posting():
    for width in (3, 4):
        sets = [set(s) for s in byte_sets(width)]
        assert all(any(s <= set(four) for s in sets) for four in combinations(range(8), 4))
    assert len(byte_sets(3)) == 20


def test_all_rows(documents):
    found = {r.doc_id: r for r in simhash_components(documents).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    keys = sorted(texts)
    fps = [slow_fingerprint(texts[k]) for k in keys]
    assert [found[k].fingerprint for k in keys] == [f"{fp:016x}" for fp in fps]
    assert [found[k].component_id for k in keys] == slow_components(keys, fps)


def test_odd_rows(odd_documents):
    found = simhash_components(odd_documents).collect()
    assert len(found) == odd_documents.count()
    blank = [r for r in found if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in blank} >= {3, 4, 5, None}
    assert {r.component_id for r in blank} == {3}
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}


def test_no_rows(no_documents):
    assert simhash_components(no_documents).collect() == []
    assert drop_near_duplicates(no_documents).collect() == []


def test_only_null_keys(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id bigint, text string")
    assert [r.component_id for r in simhash_components(rows).collect()] == [None, None]
    assert drop_near_duplicates(rows).count() == 1


@pytest.mark.parametrize("width", [3, 4])
def test_links_span_the_components(spark, width):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30, dtype=np.int64)]
    fps = set(base)
    for value in base[:10]:
        for _ in range(20):
            for b in rng.integers(0, 63, 4):
                value ^= 1 << int(b)
            fps.add(value)
    fps = sorted(fps)
    table = spark.createDataFrame([(fp,) for fp in fps], "fp bigint")
    links = near_links(table, width=width)
    parts = {r.node: r.component for r in connected_components(links, Scratch(spark)).collect()}
    want = slow_components(fps, [fp & (1 << 64) - 1 for fp in fps])
    assert [parts.get(fp, fp) for fp in fps] == want


def test_a_long_posting_gives_few_links():
    fps = np.unique(np.random.default_rng(2).integers(0, 1 << 16, 3000).astype(np.uint64) & np.uint64(0xF0F))
    a, _ = posting_links(np.zeros(len(fps), np.int64), fps, 4)
    assert len(a) < len(fps)


def test_long_postings_are_cut(spark, monkeypatch):
    monkeypatch.setattr("foretoken.llm.simhash.BLOCK", 4)
    fps = [1 << i for i in range(12)]
    links = near_links(spark.createDataFrame([(fp,) for fp in fps], "fp bigint"))
    parts = connected_components(links, Scratch(spark)).collect()
    assert {r.component for r in parts} == {1} and len(parts) == len(fps)


def test_one_of_each_group_stays(odd_documents):
    kept = drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    other = [(None, 3), (3, None), (5, 5), (140, 100), (260, 261), (260, 261)]
    links = spark.createDataFrame(chain + star + other, "a bigint, b bigint")
    parts = {r.node: r.component for r in connected_components(links, Scratch(spark)).collect()}
    assert parts == {
        **{i: 100 for i in range(100, 141)}, **{i: 7 for i in [7, *range(200, 260)]}, 260: 260, 261: 260
    }
