import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from foretoken.functions.text import split_tokens
from foretoken.operators import encoding
from foretoken.operators.encoding import (
    decode_rows,
    encode_documents,
    encode_with,
    id_range,
    token_table,
)
from foretoken.operators.vocabulary import token_counts, vocabulary

TEXTS = ["The cat, the cat!  7 cats\n", "", "été naïve\t\tx_y", "the cat the 日本語 cat"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(
        [(i % 2, i, t) for i, t in enumerate(TEXTS)], "shard int, doc_id bigint, text string"
    )


@pytest.fixture(scope="module")
def tokens(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens"))
    vocabulary(token_counts(documents), 270).write.mode("overwrite").parquet(path)
    return documents.sparkSession.read.parquet(path)


def test_tokens_join_back_to_text(documents):
    joined = documents.select("text", F.array_join(split_tokens("text"), "").alias("joined"))
    assert all(r.text == r.joined for r in joined.collect())


def test_vocabulary_is_dense_and_ordered(documents, tokens):
    rows = {r.id: r.token for r in tokens.collect()}
    assert sorted(rows) == list(range(len(rows)))
    assert rows[0] == "<|endoftext|>" and rows[1] == "<unk>"
    assert (rows[2], rows[257]) == ("<0x00>", "<0xFF>")
    counts = {r.token: r["count"] for r in token_counts(documents).collect()}
    expected = sorted(counts, key=lambda t: (-counts[t], t.encode()))
    assert [rows[i] for i in range(258, len(rows))] == expected[: 270 - 258]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 10])
def test_cut_vocabulary_keeps_the_most_frequent(spark, size):
    counts = {"a": 9, "b": 8, "c": 8, "d": 4, "e": 4, "f": 3, "g": 1, "h": 1, "i": 1, "x" * 65: 99}
    table = spark.createDataFrame(list(counts.items()), "token string, count bigint")
    got = {r.id: r.token for r in vocabulary(table, 258 + size).collect()}
    expected = sorted(counts, key=lambda t: (-counts[t], t))[1 : 1 + size]
    assert [got[i] for i in range(258, len(got))] == expected


def test_the_last_task_of_a_vocabulary_is_bounded(spark):
    table = spark.range(20000).selectExpr("cast(id as string) as token", "1L as count").repartition(16)
    plan = vocabulary(table, 260)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4
    got = sorted((r.id, r.token) for r in vocabulary(table, 260).where("id >= 258").collect())
    assert got == [(258, "0"), (259, "1")]


def test_ids_give_the_text_back(documents, tokens):
    encoded = encode_documents(documents, tokens).orderBy("doc_id").collect()
    assert encoded[1].ids == [0, 0] and encoded[1].n == 2
    assert all(r.ids[0] == 0 and r.ids[-1] == 0 and r.n == len(r.ids) for r in encoded)
    decoded = decode_rows(encode_documents(documents, tokens), tokens, "ids", "back")
    assert [r.back for r in decoded.orderBy("doc_id").collect()] == [
        "<|endoftext|>" + t + "<|endoftext|>" for t in TEXTS
    ]


def test_unknown_tokens_are_spelled_in_bytes(documents, tokens):
    other = documents.withColumn("text", F.lit("zèbra cat 日"))
    row = encode_documents(other, tokens).first()
    cat = tokens.where("token = ' cat'").first().id
    spelled = [[2 + b for b in part.encode()] for part in ("zèbra", " 日")]
    assert row.ids == [0, *spelled[0], cat, *spelled[1], 0]


def test_equal_document_ids_stay_apart(spark, tokens):
    same = spark.createDataFrame(
        [(0, 5, " cat"), (0, 5, " zebra")], "shard int, doc_id bigint, text string"
    )
    got = sorted(r.n for r in encode_documents(same, tokens).collect())
    assert got == [3, 2 + len(" zebra")]


def test_bytes_of_a_cut_character_are_shown(spark, tokens):
    word = [2 + b for b in "é日".encode()]
    rows = spark.createDataFrame(
        [(word,), (word[1:],), (word[:4],), ([258, word[0], 258],), (None,), ([],)], "tokens array<int>"
    )
    known = tokens.where("id = 258").first().token
    got = [r.text for r in decode_rows(rows, tokens).collect()]
    assert got == [
        "é日", "<0xA9>日", "é<0xE6><0x97>", f"{known}<0xC3>{known}", None, ""
    ]


def test_decoding_an_id_without_token_fails(spark, tokens):
    rows = spark.createDataFrame([([2, 999],)], "tokens array<int>")
    with pytest.raises(Exception):
        decode_rows(rows, tokens).collect()


def test_a_table_too_large_for_every_task_is_refused(spark, documents, monkeypatch):
    monkeypatch.setattr("foretoken.operators.encoding.TABLE_BYTES", 10)
    with pytest.raises(ValueError, match="too many to hand to every task"):
        decode_rows(documents, token_table(spark, ["abcdef", "ghijkl"]), "text")


def test_id_range_counts_ids_that_do_not_fit(samples_of):
    got = id_range(samples_of([[5, -1, 65535], [65536, 70000, 3]])).first()
    assert (got.n_ids, got.min_id, got.max_id, got.n_outside) == (6, -1, 70000, 3)


def test_tokenizer_of_the_caller(documents):
    def make():
        return lambda texts: [[5 + len(word) for word in text.split()] for text in texts]

    with pytest.warns(UserWarning, match="the end mark is 2 ids"):
        got = encode_with(documents, make, [1], [2, 3]).orderBy("doc_id").collect()
    assert got[0].ids == [1, 8, 9, 8, 9, 6, 9, 2, 3] and got[0].n == 9
    assert got[1].ids == [1, 2, 3]


def test_ids_over_16_bits_are_refused(documents):
    with pytest.raises(PythonException, match="do not fit 16 bits"):
        encode_with(documents, lambda: lambda texts: [[70000] for _ in texts], [], []).collect()


def test_a_tokenizer_that_adds_marks_is_told(documents):
    with pytest.warns(UserWarning, match="adds the begin mark by itself"):
        encode_with(documents, lambda: lambda texts: [[1] for _ in texts], [1], [2])


def test_public_byte_pair_encoding(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")

    def load():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def make():
        tokenizer = load()
        return lambda texts: [
            e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)
        ]

    tokenizer = load()
    got = encode_with(documents, make, [50256], [50256]).orderBy("doc_id").collect()
    for text, row in zip(TEXTS, got):
        assert row.ids[0] == row.ids[-1] == 50256
        assert tokenizer.decode(row.ids[1:-1]) == text
    size = tokenizer.get_vocab_size()
    table = token_table(spark, [tokenizer.decode([i]) for i in range(size)])
    assert table.count() == size


def test_lists_are_looked_at_in_runs(monkeypatch):
    monkeypatch.setattr(encoding, "RUN_ITEMS", 10)
    rows = [[1] * 4, None, [2] * 6, [3] * 25, [], [4] * 10, [5]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["ids"]).slice(1)
    runs = list(encoding._runs(batch, 0))
    assert [row for run in runs for row in run.column(0).to_pylist()] == rows[1:]
    assert all(len(run) == 1 or len(run.column(0).flatten()) <= 10 for run in runs) and len(runs) > 2
