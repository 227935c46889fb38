from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from foretoken.operators.ngrams import chunk_sizes, ngram_counts, ngram_partials, recombine


def by_loop(rows, n):
    return Counter(tuple(r[i : i + n]) for r in rows for i in range(len(r) - n + 1))


def counted(frame, n):
    return {tuple(r[f"id{k}"] for k in range(n)): r["count"] for r in frame.collect()}


def test_ngrams_stay_in_their_row(samples_of):
    rows = samples_of([[1, 2, 3], [4, 5, 6]])
    assert counted(ngram_counts(rows, 2), 2) == {(1, 2): 1, (2, 3): 1, (4, 5): 1, (5, 6): 1}
    assert counted(ngram_counts(rows, 3), 3) == {(1, 2, 3): 1, (4, 5, 6): 1}


def test_rows_shorter_than_the_ngram_have_none(samples_of):
    assert counted(ngram_counts(samples_of([[1], [7, 8]]), 3), 3) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_largest_ids(samples_of, n):
    rows = [[65535, 0, 65535, 65535, 1, 32768, 65535], [65535] * 7]
    assert counted(ngram_counts(samples_of(rows), n), n) == by_loop(rows, n)


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(st.lists(st.integers(0, 4), min_size=6, max_size=6), min_size=1, max_size=9),
    st.integers(1, 5),
    st.integers(1, 4),
)
def test_like_a_plain_loop_for_any_batch_size(samples_of, rows, n, batch_size):
    samples = samples_of(rows)
    assert counted(ngram_counts(samples, n), n) == by_loop(rows, n)
    partials = ngram_partials(samples, n, batch_size, 3)
    assert counted(recombine(partials, n), n) == by_loop(rows, n)


def test_one_ngram_may_be_most_rows(samples_of):
    rows = [[9] * 50] * 40 + [[1, 2] * 25]
    assert counted(ngram_counts(samples_of(rows), 2), 2) == by_loop(rows, 2)


def test_chunks_cover_all_occurrences(samples_of):
    rows = [[k, k + 1, k + 2, k] for k in range(20)]
    sizes = chunk_sizes(ngram_counts(samples_of(rows), 2), 4).collect()
    assert sorted(r.id0_chunk for r in sizes) == [0, 1, 2, 3]
    assert sum(r.n_occurrences for r in sizes) == 60


@pytest.mark.parametrize("row", [[70000, 5, 70000, 5], [1, 65536, 7, 1], [-1, 2, 3, 4]])
def test_ids_that_do_not_fit_are_an_error(samples_of, row):
    for n in (2, 3, 4):
        with pytest.raises(Exception, match="do not fit 16 bits"):
            ngram_counts(samples_of([row]), n).collect()
    got = ngram_counts(samples_of([row * 2]), 5).collect()
    assert sum(r["count"] for r in got) == 4 and any(min(row) in tuple(r) for r in got)


@pytest.mark.parametrize("n", [5, 6, 8, 9])
def test_long_ngrams_with_ids_of_any_size(samples_of, n):
    rows = [[70000, *range(12)], list(range(12)), [*range(12), -1, None, 2], [65536] * 12, [-1] * 12]
    want = Counter(tuple(r[k : k + n]) for r in rows for k in range(len(r) - n + 1))
    counts = ngram_counts(samples_of(rows), n)
    assert counts.dtypes == [*[(f"id{k}", "int") for k in range(n)], ("count", "bigint")]
    assert {tuple(r)[:-1]: r["count"] for r in counts.collect()} == want
    again = recombine(counts.union(counts), n)
    assert {tuple(r)[:-1]: r["count"] for r in again.collect()} == {k: 2 * c for k, c in want.items()}
