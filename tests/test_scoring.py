from collections import Counter, defaultdict

import numpy as np
import pytest

from foretoken.functions.membership import possible_member
from foretoken.operators.ngrams import ngram_counts
from foretoken.operators.prefixes import next_token_prefixes
from foretoken.operators.scan import scan_metrics_by_model
from foretoken.operators.scoring import score_by_model, score_by_slice

DOCUMENTS = [
    ("en", [0, 3, 4, 3, 5, 0]),
    ("en", [0, 3, 4, 0]),
    ("fr", [0, 3, 5, 3, 5, 3, 5, 0]),
    ("de", [0, 9, 0]),
]


@pytest.fixture
def encoded(spark):
    rows = [(0, k, lang, ids, len(ids)) for k, (lang, ids) in enumerate(DOCUMENTS)]
    return spark.createDataFrame(
        rows, "shard int, doc_id bigint, lang string, ids array<int>, n int"
    )


@pytest.mark.parametrize("n", [2, 3])
def test_share_in_each_slice(encoded, n):
    top = next_token_prefixes(ngram_counts(encoded, n, ids="ids"))
    got = score_by_slice(top, encoded, "lang", ["de", "en", "fr"]).collect()
    counts = defaultdict(Counter)
    for lang, ids in DOCUMENTS:
        for i in range(len(ids) - n + 1):
            counts[lang, tuple(ids[i : i + n - 1])][ids[i + n - 1]] += 1
    assert len(got) == top.count()
    for r in got:
        for lang in ("de", "en", "fr"):
            seen = counts[lang, tuple(r[f"id{k}"] for k in range(n - 1))]
            share = seen[r[f"id{n - 1}"]] / sum(seen.values()) if seen else 0.0
            assert r[f"p_{lang}"] == pytest.approx(share)


def test_models_add_one_column_each(encoded):
    def flat():
        return lambda prefix: np.zeros((len(prefix), 10))

    def last_id():
        return lambda prefix: np.eye(10)[prefix[:, -1]] * 2.0

    top = next_token_prefixes(ngram_counts(encoded, 3, ids="ids"))
    got = score_by_model(top, {"flat": flat, "last": last_id}, batch_size=2).collect()
    assert len(got) == top.count()
    for r in got:
        assert r.p_flat == pytest.approx(0.1)
        e2 = np.exp(2.0)
        assert r.p_last == pytest.approx((e2 if r.id1 == r.id2 else 1.0) / (e2 + 9))


def test_ngrams_of_other_prefixes_are_not_counted(spark, folder):
    ids = [int(k * k + k // 7) % 5000 for k in range(20_000)]
    rows = [(0, k, "en", ids[50 * k : 50 * k + 50], 50) for k in range(400)]
    encoded = spark.createDataFrame(rows, "shard int, doc_id bigint, lang string, ids array<int>, n int")
    prefixes = next_token_prefixes(ngram_counts(encoded, 3, ids="ids"))
    prefixes.orderBy("id0", "id1").limit(100).write.parquet(folder + "/top")
    top = spark.read.parquet(folder + "/top")
    likely = possible_member(top, ["id0", "id1"])
    counted = ngram_counts(encoded, 3, ["lang"], "ids", likely)
    everything = ngram_counts(encoded, 3, ["lang"], "ids")
    assert counted.count() < 100 + 0.1 * everything.count()
    wanted = everything.join(top.select("id0", "id1"), ["id0", "id1"], "left_semi")
    assert wanted.exceptAll(counted.select(wanted.columns)).count() == 0
    # The filter stands below the partial count, so what it drops is not shuffled.
    plan = score_by_slice(top, encoded, "lang", ["en"])._jdf.queryExecution().optimizedPlan().toString()
    count = plan.index("count(1)")
    assert 0 < plan.index("Generate", count) and "scalar-subquery" in plan[count : plan.index("Generate", count)]


def test_slices_without_a_filter_are_the_same(encoded, monkeypatch):
    top = next_token_prefixes(ngram_counts(encoded, 2, ids="ids"))
    filtered = sorted(score_by_slice(top, encoded, "lang", ["de", "en", "fr"]).collect())
    monkeypatch.setattr("foretoken.functions.membership.MOST_WORDS", 0)
    assert sorted(score_by_slice(top, encoded, "lang", ["de", "en", "fr"]).collect()) == filtered


def test_a_model_gets_resources_of_its_own(encoded, monkeypatch):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(4)).build
    top = next_token_prefixes(ngram_counts(encoded, 3, ids="ids"))
    given = []
    whole = type(top).mapInPandas

    def stub(self, func, schema, barrier=False, profile=None):
        given.append(profile)
        return whole(self, func, schema)

    monkeypatch.setattr(type(top), "mapInPandas", stub)

    def flat():
        return lambda *ids: np.zeros((len(ids[0]), 10))

    assert score_by_model(top, {"a": flat, "b": flat}, profile=profile).count() == top.count()
    scan_metrics_by_model(top.select("id0", "id1"), flat, profile=profile)
    assert given == [profile] * 3
