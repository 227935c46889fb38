import pytest

from foretoken.operators.prefixes import (
    add_tokens,
    by_count,
    by_fraction,
    lookup_misses,
    next_token_prefixes,
    predictive,
    rank_in_chunk,
)


def bigrams(spark, rows):
    return spark.createDataFrame(rows, "id0 int, id1 int, count bigint")


def test_ties_go_to_the_smallest_id(spark):
    got = next_token_prefixes(bigrams(spark, [(7, 5, 4), (7, 3, 4), (7, 9, 1)])).first()
    assert (got.id0, got.id1, got.sum_count, got.max_count) == (7, 3, 9, 4)
    assert got.frac_max == 4 / 9


def test_large_counts_and_ids(spark):
    got = next_token_prefixes(
        bigrams(spark, [(65535, 65535, 1 << 45), (65535, 0, (1 << 45) - 1)])
    ).first()
    assert (got.id1, got.max_count) == (65535, 1 << 45)


def test_limits_are_strict(spark):
    rows = [(1, 1, 5), (1, 2, 5), (2, 1, 9), (2, 2, 1), (3, 1, 11)]
    table = next_token_prefixes(bigrams(spark, rows))
    assert {r.id0 for r in predictive(table, 0.5).collect()} == {2, 3}
    assert {r.id0 for r in predictive(table, 0.5, 10).collect()} == {3}


@pytest.fixture
def tokens(spark):
    return spark.createDataFrame([(k, f" t{k}") for k in range(6)], "id int, token string")


def test_tokens_and_sequence(spark, tokens):
    table = next_token_prefixes(bigrams(spark, [(1, 2, 3)]))
    got = add_tokens(table, tokens).first()
    assert (got.token0, got.token1, got.seq) == (" t1", " t2", " t1 t2")


def test_missing_token_is_an_error(spark, tokens):
    table = next_token_prefixes(bigrams(spark, [(1, 77, 3)]))
    with pytest.raises(Exception, match="no token for id 77"):
        add_tokens(table, tokens).collect()
    misses = {r.position: (r.n_ids, r.n_missing) for r in lookup_misses(table, tokens).collect()}
    assert misses == {0: (1, 0), 1: (1, 1)}


def test_orders(spark):
    rows = [(1, 1, 5), (1, 2, 4), (2, 1, 3), (3, 1, 3), (4, 1, 100), (4, 2, 100)]
    table = next_token_prefixes(bigrams(spark, rows))
    assert [r.id0 for r in by_fraction(table).collect()] == [2, 3, 1, 4]
    assert [r.id0 for r in by_count(table).collect()] == [4, 1, 2, 3]


def test_rank_in_chunk_is_a_row_number(spark):
    rows = [
        (k % 2, k % 5, k % 7, 0, 1 + k % 3, [1.0, 0.5, 0.25, 0.2501][k % 4]) for k in range(140)
    ]
    rows = list({r[:3]: r for r in rows}.values())
    table = spark.createDataFrame(
        rows, "id0_chunk int, id0 int, id1 int, id2 int, sum_count int, frac_max double"
    )
    got = {(r.id0_chunk, r.id0, r.id1): r["rank"] for r in rank_in_chunk(table).collect()}
    for chunk in (0, 1):
        mine = sorted((r for r in rows if r[0] == chunk), key=lambda r: (-r[5], r[1], r[2]))
        assert [got[r[:3]] for r in mine] == list(range(1, len(mine) + 1))
