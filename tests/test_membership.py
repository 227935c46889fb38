import pytest
from pyspark.sql import functions as F

from foretoken.functions import membership
from foretoken.functions.membership import filter_words, possible_member, words_for


@pytest.fixture
def numbers(spark):
    return spark.range(100_000).selectExpr("cast(id as int) as id0", "cast(id % 7 as int) as id1")


def test_no_member_is_lost_and_few_others_pass(numbers):
    members = numbers.where("id0 % 25 = 3")
    kept = numbers.where(possible_member(members, ["id0", "id1"]))
    assert kept.join(members, ["id0", "id1"], "left_semi").count() == members.count() == 4000
    assert kept.count() < 4000 + 0.04 * 96_000


def test_one_key_no_key_and_nulls(spark, numbers):
    one = numbers.where("id0 = 5")
    assert numbers.where(possible_member(one, ["id0", "id1"])).where("id0 = 5").count() == 1
    assert numbers.where(possible_member(numbers.where("false"), ["id0", "id1"])).count() == 0
    odd = spark.createDataFrame([(None, 1), (2, None)], "id0 int, id1 int")
    assert odd.where(possible_member(odd, ["id0", "id1"])).count() == 2


def test_words(numbers):
    assert [words_for(k) for k in (0, 1, 4, 5, 1000)] == [1, 1, 1, 2, 256]
    most = membership.MOST_WORDS * membership.KEYS_PER_WORD
    assert words_for(most) == membership.MOST_WORDS and words_for(most + 1) is None
    bits = filter_words(numbers.limit(50), ["id0", "id1"], 64).first().bits
    assert len(bits) == 64 and any(bits)


def test_no_filter_beyond_its_bound(numbers, monkeypatch):
    monkeypatch.setattr(membership, "MOST_WORDS", 8)
    assert possible_member(numbers, ["id0", "id1"]) is None
    assert possible_member(numbers.limit(32), ["id0", "id1"]) is not None
    assert numbers.select(F.max("id0")).first()[0] == 99_999
