import pytest

from foretoken.session import shared_folder, shuffle_partitions
from foretoken.settings import Settings


def test_partitions_grow_with_the_corpus():
    assert shuffle_partitions(0) == 200
    assert shuffle_partitions(10 << 40) == 40960
    assert shuffle_partitions(100 << 40) == 100_000


def test_folder_is_under_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    one, two = shared_folder(spark), shared_folder(spark)
    assert one != two
    if named:
        assert one.startswith(named)


@pytest.mark.parametrize("bad", [{"vocab_size": 70000}, {"row_length": 0}, {"n_shards": 1 << 16}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
