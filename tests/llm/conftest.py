import pytest

SF = "/root/testdata/sf0.001"
LONG = "word " * 40_000 + "end"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    rows = [
        (1, "The cat sat on the mat and looked at the dog.", "en", "a", 0),
        (1, "The cat sat on the mat and looked at the dog.", "en", "a", 0),
        (2, "The cat sat on the mat and looked at the dog.", "en", "a", 1),
        (3, None, "en", None, 2),
        (4, "", None, "a", 3),
        (5, " \t\n ", "de", "a", 4),
        (None, "Der Hund und die Katze sitzen auf der Matte.", "de", "b", 5),
        (None, None, None, None, None),
        (6, LONG, "en", "b", 6),
        (7, "12345 !!! 678", "fr", "b", 7),
        (8, "Der Hund und die Katze sitzen auf der Matte hier.", "de", "b", 8),
        (9, "日本語のテキスト 😀 é́ \u0000 x", None, "b", 9),
        (10, "a", "en", "b", 10),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, key int")
    # Names that the operators use inside.
    for name in ("row", "_key", "_found", "found", "fp", "node", "group", "unit", "count", "_row"):
        frame = frame.withColumn(name, frame["key"])
    return frame


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

