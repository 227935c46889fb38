import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretoken.operators import scan
from foretoken.operators.ngrams import ngram_counts

VOCAB = 7


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(5)
    return [[min(pick.randrange(VOCAB), pick.randrange(VOCAB)) for _ in range(24)] for _ in range(12)]


@pytest.fixture(scope="module")
def tokens(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens"))
    spark.createDataFrame([(k, f" w{k}") for k in range(VOCAB)], "id int, token string").write.mode(
        "overwrite"
    ).parquet(path)
    return spark.read.parquet(path)


def brute_force(rows, seq_len, backoff):
    """Every long context against every token its short context knows."""
    short, long = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        for i in range(len(r) - seq_len):
            short[tuple(r[i : i + seq_len])][r[i + seq_len]] += 1
        for i in range(len(r) - seq_len - 1):
            long[tuple(r[i : i + seq_len + 1])][r[i + seq_len + 1]] += 1
    out = {}
    for context, seen in long.items():
        known, n = short[context[1:]], sum(seen.values())
        total = sum(known.values())
        ps = {t: c / total for t, c in known.items()}
        pl = {t: (seen[t] + backoff * ps[t]) / (n + backoff) for t in known}
        logs = {t: math.log(pl[t]) - math.log(ps[t]) for t in known}
        out[context] = (
            n,
            max(ps.values()),
            max(pl.values()),
            sum((pl[t] - ps[t]) * logs[t] for t in known) / 2,
            max(abs(pl[t] - ps[t]) for t in known),
            max(logs.values()),
            max(-v for v in logs.values()),
            min(known, key=lambda t: (-ps[t], t)),
            min(known, key=lambda t: (-pl[t], t)),
        )
    return out


@pytest.mark.parametrize("seq_len,backoff", [(1, 1.0), (2, 1.0), (2, 0.3), (1, 25.0), (3, 2.0)])
def test_metrics_like_the_full_comparison(samples_of, rows, seq_len, backoff):
    samples = samples_of(rows)
    got = scan.scan_metrics(
        ngram_counts(samples, seq_len + 1), ngram_counts(samples, seq_len + 2), backoff
    ).collect()
    want = brute_force(rows, seq_len, backoff)
    assert len(got) == len(want)
    for r in got:
        expected = want[tuple(r[f"id{k}"] for k in range(seq_len + 1))]
        assert r.n_context == expected[0]
        assert tuple(r[m] for m in scan.METRICS[:6]) == pytest.approx(expected[1:7], abs=1e-9)
        assert r.short_max_id == expected[7]
        if backoff <= 2:
            # With a strong fallback two tokens can be equally likely up to rounding.
            assert r.long_max_id == expected[8]


def test_a_context_with_very_many_next_tokens(spark):
    """The long context 1 has seen the commonest 16,400 tokens after 3, the long context 2 all of them."""
    n, seen = 20_000, 16_400
    grams = spark.range(n).select(
        F.lit(3).alias("id1"), F.col("id").cast("int").alias("id2"), (2 * n - F.col("id")).alias("count")
    )
    long = grams.select(F.lit(2).alias("id0"), "*").unionByName(
        grams.where(F.col("id2") < seen).select(F.lit(1).alias("id0"), "*")
    )
    short = grams.select(F.col("id1").alias("id0"), F.col("id2").alias("id1"), "count")
    some, every = scan.scan_metrics(short, long, 1.0).orderBy("id0").collect()
    counts = [2 * n - k for k in range(n)]
    total, n_context = sum(counts), sum(counts[:seen])
    assert (some.n_context, every.n_context) == (n_context, total)
    # The commonest of the tokens not seen falls from its short probability to almost none.
    assert some.p_delta_max == pytest.approx(counts[seen] / total * n_context / (n_context + 1))
    assert some.logit_inhibit_max == pytest.approx(math.log(n_context + 1))
    assert every.p_delta_max == pytest.approx(0, abs=1e-9)
    assert (some.long_max_id, every.long_max_id, every.short_max_id) == (0, 0, 0)


def test_probabilities_sum_to_one(samples_of, rows):
    samples = samples_of(rows)
    dist = scan.next_token_distribution(ngram_counts(samples, 2), ngram_counts(samples, 3), 1.0)
    left = dist.groupBy("id0", "id1").agg(
        F.sum("p_long").alias("seen"),
        F.sum("p_short").alias("mass"),
        F.first("n_context").alias("n"),
    )
    for r in left.collect():
        assert r.seen + (1 - r.mass) / (r.n + 1) == pytest.approx(1.0)


@pytest.mark.parametrize("seq_len", [1, 4])
def test_windows(samples_of, seq_len):
    row = list(range(10, 20))
    got = scan.paired_windows(samples_of([row]), seq_len).orderBy("start").collect()
    assert len(got) == len(row) - seq_len
    for i, r in enumerate(got):
        assert r.start == i + 1
        assert list(r.long_ids) == row[i : i + seq_len + 1]
        assert list(r.short_ids) == row[i + 1 : i + seq_len + 1]


def test_row_as_short_as_the_context(samples_of):
    assert scan.windows(samples_of([[1, 2]]), 2).count() == 0


@pytest.fixture
def hits(spark):
    def make(contexts):
        return spark.createDataFrame(
            [(*c, 0.2, p, 0.9, 0.1, 1.0, 2.0, 1, 2) for c, p in contexts],
            "id0 int, id1 int, p_short double, p_long double, js double, p_delta_max double, "
            "logit_excite_max double, logit_inhibit_max double, short_max_id int, long_max_id int",
        )

    return make


@pytest.fixture(params=["10m", "-1"])
def threshold(spark, request):
    """Both ways of joining: by broadcast and by shuffle."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, request.param)
    yield
    spark.conf.unset(key)


def test_context_is_cut_at_both_ends(samples_of, hits, tokens, threshold):
    rows = [[k % VOCAB for k in range(14)], [6] * 14]
    found = scan.scan_examples(
        samples_of(rows), hits([((0, 1), 0.9), ((5, 6), 0.8)]), tokens, 1, 5
    )
    got = {(r.batch, r.sample, r.start): r for r in found.collect()}
    assert set(got) == {(0, 0, 1), (0, 0, 6), (0, 0, 8), (0, 0, 13)}
    for (_, _, start), r in got.items():
        begin, end = max(start - 5, 0), min(start + 6, 14)
        assert list(r.context_ids) == rows[0][begin:end]
        assert r.context == "".join(f" w{t}" for t in r.context_ids)
        assert r.text == f"[ w{r.long_ids[0]}] w{r.long_ids[1]}"
        assert (r.token_short, r.token_long) == (" w1", " w2")


def test_first_place_of_a_text_is_kept(spark, samples_of, hits, tokens, threshold):
    rows = [[3, 3, 3, 3], [0, 1, 0, 1], [1, 0, 1, 2], [0, 1, 5, 0]]
    samples = samples_of(rows).unionByName(samples_of([[5, 0, 0, 1]], shard=1))
    table = hits([((0, 1), 0.7), ((5, 0), 0.8)])
    found = scan.scan_filter(samples, table, tokens, 2, 5)
    got = [(r.text, r.shard, r.batch, r.sample, r.start) for r in scan.scan_top(found).collect()]
    assert got == [("[ w5] w0", 0, 1, 1, 3), ("[ w0] w1", 0, 0, 1, 1)]
    every = scan.scan_examples(samples, table, tokens, 2, 5).collect()
    first = {}
    for r in sorted(every, key=lambda r: (r.shard, r.batch, r.sample, r.start)):
        first.setdefault(r.text, r)
    assert sorted(found.collect()) == sorted(first.values())


def test_a_sample_too_large_for_the_order_is_an_error(samples_of, hits, tokens):
    far = samples_of([[0, 1, 0]]).withColumn("sample", F.lit((1 << 32) + 3))
    table = hits([((0, 1), 0.9)])
    with pytest.raises(Exception, match="no place for sample 4294967299"):
        scan.scan_filter(far, table, tokens, 4).collect()
    assert [(r.batch, r.sample) for r in scan.scan_examples(far, table, tokens, 4).collect()] == [
        (1 << 30, 3)
    ]


def test_rows_are_read_once_for_examples(samples_of, hits, tokens, spark, tmp_path):
    from foretoken.sources.samples import read_samples, write_samples

    write_samples(samples_of([[0, 1, 0]]), str(tmp_path / "rows"))
    table = hits([((0, 1), 0.9)])
    table.write.parquet(str(tmp_path / "hits"))
    found = scan.scan_examples(
        read_samples(spark, str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "hits")), tokens, 4
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and len(re.findall(r"FileScan parquet \[sample", plan)) == 1


def test_texts_of_different_contexts_are_one(spark, samples_of, hits, tmp_path):
    spark.createDataFrame([(0, "a"), (1, "bc"), (2, "a"), (3, "")], "id int, token string").write.parquet(
        str(tmp_path / "t")
    )
    alike = spark.read.parquet(str(tmp_path / "t"))
    samples = samples_of([[2, 1, 3, 0, 1, 3]])
    found = scan.scan_filter(samples, hits([((0, 1), 0.6), ((2, 1), 0.9)]), alike, 4).collect()
    assert [(r.text, r.start, r.p_long) for r in found] == [("[a]bc", 1, 0.9)]


def test_metrics_of_a_model(samples_of, rows):
    def predictor():
        def predict(short, long):
            base = np.arange(VOCAB)[None, :]
            return base * 0.1 * (1 + short.sum(axis=1))[:, None], base * 0.2 * (long[:, :1] - 3)

        return predict

    contexts = scan.windows(samples_of(rows), 2).select("id0", "id1", "id2")
    got = scan.scan_metrics_by_model(contexts, predictor, micro_batch=3).collect()
    assert len(got) == contexts.distinct().count()
    for r in got:
        long = np.array([[r.id0, r.id1, r.id2]])
        s, m = (x[0] for x in predictor()(long[:, 1:], long))
        ps, pl = np.exp(s) / np.exp(s).sum(), np.exp(m) / np.exp(m).sum()
        kl = lambda a, b: (a * (np.log(a) - np.log(b))).sum()
        assert r.js == pytest.approx((kl(ps, pl) + kl(pl, ps)) / 2)
        assert r.p_short == pytest.approx(ps.max()) and r.p_long == pytest.approx(pl.max())
        assert r.p_delta_max == pytest.approx(abs(ps - pl).max())
        assert r.logit_excite_max == pytest.approx((m - s).max())
        assert r.logit_inhibit_max == pytest.approx((s - m).max())
        assert (r.short_max_id, r.long_max_id) == (ps.argmax(), pl.argmax())


def test_hits_are_strict(spark):
    rows = [(1, 0.5, 0.9), (2, 0.9, 0.5), (3, 0.6, 0.6)]
    table = spark.createDataFrame(rows, "id0 int, p_long double, js double")
    assert [r.id0 for r in scan.scan_hits(table).collect()] == [3]


@pytest.fixture
def without_broadcasts(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)


def formatted(spark, frame):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def test_no_row_moves_with_its_places(spark, samples_of, rows, tokens, folder, without_broadcasts):
    samples_of(rows).write.parquet(f"{folder}/samples")
    samples = spark.read.parquet(f"{folder}/samples")
    hits = scan.scan_metrics(ngram_counts(samples, 2), ngram_counts(samples, 3), 1.0)
    hits.write.parquet(f"{folder}/hits")
    hits = spark.read.parquet(f"{folder}/hits")
    for make in (scan.scan_examples, scan.scan_filter):
        plan = formatted(spark, make(samples, hits, tokens, 4))
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert moved and not any(re.search(r"\btokens#", columns) for columns in moved)
        assert len(re.findall(r"\) Scan parquet[^\n]*\nOutput[^\n]*tokens#", plan)) == 1


def test_keys_of_more_than_four_ids(samples_of):
    rows = [[1, 65535, 3, 4, 5, 6, 7, 8, 1, 65535, 3, 4, 5, 6, 9]] * 2
    samples = samples_of(rows)
    for n in (5, 6, 8):
        want = Counter(tuple(r[i : i + n]) for r in rows for i in range(len(r) - n + 1))
        counted = ngram_counts(samples, n)
        assert {tuple(r)[:n]: r["count"] for r in counted.collect()} == want
        keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", counted._jdf.queryExecution().toString())
        assert keys and all(len(k.split(",")) == 2 for k in keys)


@pytest.mark.parametrize("seq_len", [1, 2])
def test_a_frequent_short_context_in_parts(samples_of, rows, monkeypatch, seq_len):
    monkeypatch.setattr(scan, "PART_PLACES", 5)
    monkeypatch.setattr(scan, "FEWEST", 1)
    samples = samples_of(rows)
    short, long = ngram_counts(samples, seq_len + 1), ngram_counts(samples, seq_len + 2)
    joined, key = scan._beside_short(short, long)
    assert joined.select("part").distinct().count() > 1
    got = {tuple(r[f"id{k}"] for k in range(seq_len + 1)): r for r in scan.scan_metrics(short, long, 1.0).collect()}
    want = brute_force(rows, seq_len, 1.0)
    assert set(got) == set(want)
    for context, r in got.items():
        assert (r.n_context, *[r[m] for m in scan.METRICS]) == pytest.approx(want[context], abs=1e-9)


def test_long_ngrams_are_moved_once(spark, samples_of, rows, folder, without_broadcasts):
    samples = samples_of(rows)
    for n in (2, 3):
        ngram_counts(samples, n).write.parquet(f"{folder}/{n}")
    short, long = (spark.read.parquet(f"{folder}/{n}") for n in (2, 3))
    for found in (scan.scan_metrics(short, long, 1.0), scan.next_token_distribution(short, long, 1.0)):
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", formatted(spark, found))
        assert sum("first#" in columns for columns in moved) == 1


def test_short_ngrams_are_moved_once(spark, samples_of, rows, folder, without_broadcasts):
    """And as they are counted, without what the scan says of them."""
    samples = samples_of(rows)
    for n in (2, 3):
        ngram_counts(samples, n).write.parquet(f"{folder}/{n}")
    short, long = (spark.read.parquet(f"{folder}/{n}") for n in (2, 3))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", formatted(spark, scan.scan_metrics(short, long, 1.0)))
    whole = [columns for columns in moved if "next#" in columns or "id1#" in columns]
    assert len(whole) == 1 and "said#" not in whole[0]


def test_one_place_of_a_context_and_task_is_moved(spark, samples_of, rows, tokens, folder, without_broadcasts):
    samples = samples_of(rows)
    hits = scan.scan_metrics(ngram_counts(samples, 2), ngram_counts(samples, 3), 1.0)
    hits.write.parquet(f"{folder}/hits")
    plan = formatted(spark, scan.scan_filter(samples, spark.read.parquet(f"{folder}/hits"), tokens, 4))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert not any("context_ids#" in columns for columns in moved)


def test_token_table_is_joined_without_a_shuffle(spark, samples_of, rows, tokens, hits, without_broadcasts):
    found = scan.scan_examples(samples_of(rows), hits([((0, 1), 0.9)]), tokens, 4)
    assert formatted(spark, found).count(") SortMergeJoin") <= 1
