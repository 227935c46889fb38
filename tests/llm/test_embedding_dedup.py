import math

import numpy as np
import pytest

from foretoken.llm.embedding_dedup import embedding_components

NAN, INF = math.nan, math.inf


def slow(rows, threshold=0.9):
    usable = [
        i for i, (_, v) in enumerate(rows)
        if v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    link = {i: set() for i in range(len(rows))}
    for i in usable:
        for j in usable:
            a, b = rows[i][1], rows[j][1]
            if i != j and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    link[i].add(j)
    out = []
    for i in range(len(rows)):
        reached, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - reached:
                reached.add(j)
                todo.append(j)
        keys = [rows[j][0] for j in reached if rows[j][0] is not None]
        least = min(keys) if keys else None
        out.append((rows[i][0], len(link[i]), least, rows[i][0] == least))
    return out


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    found = [tuple(r) for r in embedding_components(frame, **options).collect()]
    order = lambda r: str(r)
    assert sorted(found, key=order) == sorted(slow(rows, options.get("threshold", 0.9)), key=order)


def clusters(rng, n, dim):
    base = rng.normal(size=(n // 5, dim))
    return [
        (i, (base[i % len(base)] + rng.normal(scale=0.35, size=dim)).tolist()) for i in range(n)
    ]


@pytest.mark.parametrize("dim", [1, 2, 3, 16, 64])
def test_against_all_pairs(spark, dim):
    check(spark, clusters(np.random.default_rng(dim), 150, dim))


def test_many_groups_and_tiles(spark, monkeypatch):
    monkeypatch.setattr("foretoken.llm.embedding_dedup.GROUP", 32)
    monkeypatch.setattr("foretoken.llm.embedding_dedup.TILE", 8)
    check(spark, clusters(np.random.default_rng(9), 200, 8), threshold=0.8)


def test_chains(spark):
    angles = np.linspace(0, 3, 40)
    check(spark, [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)], threshold=0.99)


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, []),
        (6, [0.0, 0.0]), (7, [NAN, 1.0]), (8, [INF, 1.0]), (9, [None, 1.0]), (None, [0.0, 1.0]),
        (None, [0.0, 1.0]), (10, [0.0, 5.0]), (11, [1.0, 0.0, 0.0]), (12, [1e-30, 0.0]), (13, [1e30, 0.0]),
        (14, [-0.0, 3.0]), (None, None),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for name in ("id", "vector", "count", "group", "key"):
        frame = frame.withColumn(name, frame["vec_id"])
    found = {}
    for r in embedding_components(frame).collect():
        found.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    for key, n, least, _ in slow(rows):
        assert (n, least) in [(a, b) for a, b, _ in found[key]]
    assert found[1] == [(4, 1, True)] * 2 and found[2] == [(4, 1, False)]
    assert found[4] == [(0, 4, True)] and found[6] == [(0, 6, True)]
    assert embedding_components(frame.where("false")).collect() == []


def test_double_vectors_of_any_magnitude(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e200, -1e200])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in embedding_components(frame).collect()) == [
        (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)
    ]
