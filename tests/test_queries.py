"""Every registered query gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"


# Operators of the optional subpackage have tests of their own.
NAMES = [name for name in entry.queries() if name not in entry.EXTRA]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(NAMES) == set(entry.oracle_sql()) - set(entry.EXTRA)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, name):
    same, got, want, *_ = compare(spark, con, SF, name, entry.oracle_sql()[name])
    assert same, f"{got} rows, SQL gives {want}"
    assert got > 0


# Large enough for tokens outside the table, which are spelled in bytes.
SPELLED_SF = "/root/testdata/sf0.01"
SPELLED = ["decode_samples", "decoded_documents", "scan_examples", "scan_filter", "scan_top"]


@pytest.mark.parametrize("name", SPELLED)
def test_same_rows_where_ids_are_bytes(spark, name):
    same, got, want, *_ = compare(spark, connect(SPELLED_SF), SPELLED_SF, name, entry.oracle_sql()[name])
    assert same, f"{got} rows, SQL gives {want}"


def test_entry(spark):
    assert entry.entry(spark).columns[:4] == ["id0", "id1", "sum_count", "max_count"]


def test_changed_files_are_read_again(spark, tmp_path):
    from foretoken.plans.queries import QUERIES

    table = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (40, 60):
        table.limit(rows).coalesce(1).write.mode("overwrite").parquet(
            str(tmp_path / "documents.parquet")
        )
        got = QUERIES["encoded_documents"](spark, str(tmp_path)).count()
        assert got == rows
