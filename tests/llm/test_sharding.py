import zlib

import numpy as np

from foretoken.llm.sharding import pack_vectors, shard_documents


def check(rows, texts, shards=40):
    assert len(rows) == len(texts)
    want = sorted(
        (len((t or "").encode()) + 16, -1 if t is None else zlib.crc32(t.encode())) for _, t in texts
    )
    assert sorted((r.size, -1 if r.text_crc32 is None else r.text_crc32) for r in rows) == want
    by_shard = {}
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by_shard.setdefault(r.shard, []).append(r)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {shard: sum(r.size for r in own) for shard, own in by_shard.items()}


def test_units_go_where_the_dot_product_is_highest():
    weights = np.array([[3.0, 1.0], [3.0, 1.0], [1.0, 3.0], [1.0, 3.0]])
    placed = pack_vectors(weights, 2)
    assert (np.bincount(placed, weights[:, 0]) == 4).all() and (np.bincount(placed, weights[:, 1]) == 4).all()
    assert pack_vectors(np.zeros((0, 3)), 4).tolist() == []
    assert pack_vectors(np.zeros((3, 3)), 4).tolist() == [0, 0, 0]


def test_all_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = shard_documents(documents).collect()
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    sizes = check(rows, texts)
    assert len(sizes) == 40 and max(sizes.values()) <= 1.03 * min(sizes.values())
    counts = np.bincount([r.shard for r in rows])
    assert counts.max() <= 1.1 * counts.min()
    # Equal texts share a shard, but for groups of over a quarter of one.
    text_of = dict(texts)
    groups = {}
    for r in rows:
        groups.setdefault(text_of[r.doc_id], []).append(r)
    quarter = sum(sizes.values()) / 40 / 4
    kept = [g for g in groups.values() if sum(r.size for r in g) < 0.9 * quarter and len(g) < 50]
    assert len(kept) >= len(groups) - 3 and all(len({r.shard for r in g}) == 1 for g in kept)


def test_a_hot_group_is_split(spark):
    texts = [(i, "copy " * 20) for i in range(1000)] + [(1000 + i, f"{i} " * 30) for i in range(2000)]
    sizes = check(
        shard_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect(), texts
    )
    assert len(sizes) == 40 and max(sizes.values()) <= 1.25 * min(sizes.values())


def test_odd_rows(odd_documents, no_documents):
    check(shard_documents(odd_documents).collect(), [(r.doc_id, r.text) for r in odd_documents.collect()])
    assert shard_documents(no_documents).collect() == []
