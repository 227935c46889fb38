import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foretoken.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


@pytest.fixture(scope="session")
def encoded_of(spark):
    """Encoded documents with the given lengths; ids count up over each shard."""

    def make(shards):
        rows = []
        for shard, lengths in shards.items():
            nth = 0
            for k, n in enumerate(lengths):
                rows.append((shard, 10 * k + shard, list(range(nth, nth + n)), n))
                nth += n
        return spark.createDataFrame(rows, "shard int, doc_id bigint, ids array<int>, n int")

    return make


@pytest.fixture(scope="session")
def samples_of(spark):
    def make(rows, shard=0):
        return spark.createDataFrame(
            [(shard, i, list(r)) for i, r in enumerate(rows)],
            "shard int, sample bigint, tokens array<int>",
        )

    return make
