"""The registered queries of the subpackage: those with SQL give its rows, all run in the pipeline."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare

SF = "/root/testdata/sf0.001"
NAMES = [name for name in entry.queries() if name.startswith("op") or name == "pipeline"]


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in NAMES if name != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in NAMES


@pytest.mark.parametrize("name", [name for name in NAMES if name in entry.oracle_sql()])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    same, got, want, *_ = compare(spark, con, SF, name, entry.oracle_sql()[name])
    assert same and got == want > 0


def test_stages_of_the_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, left = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == documents.columns
        rows = made.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        docs = spark.createDataFrame(rows, documents.schema)
        left.append(len(rows))
    assert left[0] == documents.count()  # every test document has a language
    assert left[2] < left[1] and left[3] < left[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.start)
    assert [tuple(r)[:5] for r in sorted(whole, key=key)] == [tuple(r)[:5] for r in sorted(pieces, key=key)]


def test_stages_take_odd_rows(spark, odd_documents, no_documents):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, frame, SF)
            assert made.columns == frame.columns and made.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() >= frame.count()
    assert documents.columns
