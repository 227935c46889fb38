import glob
import os

import pytest
from pyspark.sql import functions as F

from foretoken.operators.control import shard_states
from foretoken.operators.encoding import encode_documents
from foretoken.operators.packing import pack_wrap
from foretoken.plans.pipeline import Pipeline, Tokenizer
from foretoken.settings import Settings
from foretoken.sources.documents import read_documents

PATH = "/root/testdata/sf0.001/documents.parquet"
SETTINGS = Settings(row_length=64, n_shards=3, seq_len=1, min_trigram_count=5)


def test_all_tables_and_their_totals(spark, folder):
    p = Pipeline(spark, read_documents(spark, PATH, 3), SETTINGS, folder)
    rows = p.samples().count()
    assert p.samples().where(F.size("tokens") != 64).count() == 0
    for n in (2, 3):
        assert p.ngrams(n).agg(F.sum("count")).first()[0] == rows * (65 - n)
        prefixes = p.prefixes(n)
        assert prefixes.where("frac_max <= 0 or frac_max > 1").count() == 0
        assert prefixes.agg(F.sum("sum_count")).first()[0] == rows * (65 - n)
        assert p.top(n).where("frac_max <= 0.5").count() == 0
    found = p.scan_filter()
    assert found.count() == found.select("text").distinct().count() > 0
    assert found.where("p_long <= 0.5 or js <= 0.5").count() == 0


def written(folder):
    """When the files of each table were written."""
    return {
        f: os.path.getmtime(f) for f in glob.glob(folder + "/*/**/*.parquet", recursive=True)
        if "manifest" not in f
    }


def test_finished_tables_are_not_built_again(spark, folder):
    first = Pipeline(spark, read_documents(spark, PATH, 3), SETTINGS, folder)
    before = sorted(first.samples().collect())
    files = written(folder)
    second = Pipeline(spark, read_documents(spark, PATH, 3), SETTINGS, folder)
    assert sorted(second.samples().collect()) == before and written(folder) == files
    assert second.ngrams(2).count() > 0


@pytest.mark.parametrize(
    "settings, shards, limit",
    [(Settings(row_length=32, n_shards=3), 3, None), (SETTINGS, 3, 5), (Settings(row_length=64, n_shards=2), 2, None)],
)
def test_other_settings_or_documents_are_built_anew(spark, folder, settings, shards, limit):
    Pipeline(spark, read_documents(spark, PATH, 3), SETTINGS, folder).ngrams(2)
    documents = read_documents(spark, PATH, shards)
    if limit:
        documents = documents.where(F.col("doc_id") < limit)
    again = Pipeline(spark, documents, settings, folder)
    fresh = Pipeline(spark, documents, settings)
    assert sorted(again.samples().collect()) == sorted(fresh.samples().collect())
    assert again.encoded().count() == documents.count()
    assert sorted(again.ngrams(2).collect()) == sorted(fresh.ngrams(2).collect())


def test_changed_rows_in_memory_are_seen(spark, folder):
    for text in ("a b a b", "c d c d e"):
        rows = spark.createDataFrame([(0, 1, text)], "shard int, doc_id bigint, text string")
        p = Pipeline(spark, rows, Settings(row_length=2, n_shards=1), folder)
        tokens = {r.token for r in p.tokens().where("id >= 258").collect()}
        assert tokens == {"a", " b", " a"} if text[0] == "a" else tokens == {"c", " d", " c", " e"}


def test_scan_of_chosen_shards_is_not_kept(spark):
    p = Pipeline(spark, read_documents(spark, PATH, 3), SETTINGS)
    found = [p.scan_filter(p.samples().where(F.col("shard") == k)) for k in (0, 1)]
    assert [{r.shard for r in f.collect()} for f in found] == [{0}, {1}]
    assert {r.shard for r in p.scan_filter().collect()} >= {0, 1}


def test_a_stopped_build_of_rows_goes_on(spark, folder):
    settings = Settings(row_length=64, n_shards=4, shards_per_job=1)
    p = Pipeline(spark, read_documents(spark, PATH, 4), settings, folder)
    stopped = {"left": 2}

    def packing(encoded, length):
        stopped["left"] -= 1
        if stopped["left"] < 0:
            raise KeyboardInterrupt
        return pack_wrap(encoded, length)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("foretoken.plans.pipeline.pack_wrap", packing)
        with pytest.raises(KeyboardInterrupt):
            p.samples()
    files = {f: t for f, t in written(folder).items() if "/samples/" in f}
    assert len({f.split("shard=")[1][0] for f in files}) == 2
    again = Pipeline(spark, read_documents(spark, PATH, 4), settings, folder)
    whole = Pipeline(spark, read_documents(spark, PATH, 4), settings).samples()
    assert sorted(again.samples().collect()) == sorted(whole.collect())
    assert files.items() <= written(folder).items()


def test_parts_of_the_source(spark):
    settings = Settings(
        row_length=64, n_shards=4, begin_shard=1, end_shard=3, n_samples_per_shard=9, batch_size=4, batches=1
    )
    p = Pipeline(spark, read_documents(spark, PATH, 4), settings)
    assert {(r.shard, r["count"]) for r in p.samples().groupBy("shard").count().collect()} == {(1, 9), (2, 9)}
    assert p.ngrams(2).agg(F.sum("count")).first()[0] == 2 * 4 * 63


def test_a_tokenizer_of_the_caller(spark, folder):
    def make():
        return lambda texts: [[3 + ord(c) % 50 for c in text] for text in texts]

    own = Tokenizer("letters", make, [f"t{i}" for i in range(60)], [1], [2])
    p = Pipeline(spark, read_documents(spark, PATH, 2), Settings(row_length=64, n_shards=2), folder, tokenizer=own)
    first = p.encoded().first()
    assert first.ids[0] == 1 and first.ids[-1] == 2 and max(first.ids) < 53
    top = p.top(2).first()
    assert top.seq == f"t{top.id0}t{top.id1}"


def test_scored_tables_and_export(spark, folder):
    p = Pipeline(spark, read_documents(spark, PATH, 2, ("lang",)), Settings(row_length=64, n_shards=2, min_trigram_count=3))
    scored = p.scored(2, "lang", ["de", "en"]).orderBy("rank").collect()
    assert [r.rank for r in scored] == list(range(1, p.top(2).count() + 1))
    assert [r.sum_count for r in scored] == sorted((r.sum_count for r in scored), reverse=True)
    assert {"p_de", "p_en"} <= set(scored[0].asDict())
    names = p.export(folder + "/out")
    assert len(names) == 8
    for n in (2, 3):
        assert spark.read.parquet(f"{folder}/out/ngrams_{n}").count() == p.ngrams(n).count()


def test_long_contexts_and_rows_without_wrapping(spark):
    settings = Settings(row_length=64, n_shards=2)
    p = Pipeline(spark, read_documents(spark, PATH, 2), settings, wrap=False)
    assert p.scan_hits().columns[:5] == ["id0", "id1", "id2", "id3", "id4"]
    hits = p.scan_filter()
    assert hits.where(F.size("long_ids") != 5).count() == 0


def per_shard_files(spark, path, texts):
    """One file for each shard: documents k of shard s have the number 3 * k + s."""
    for shard, group in texts.items():
        rows = [(3 * k + shard, text) for k, text in enumerate(group)]
        table = spark.createDataFrame(rows, "doc_id bigint, text string")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/file{shard}")


def from_files(spark, path):
    return read_documents(spark, f"{path}/file*", 3, spread=False)


TEXTS = {s: [f"a b c d {'e f ' * (5 * s + k)}" for k in range(8)] for s in range(3)}


def test_one_changed_file_rebuilds_its_shard_only(spark, folder):
    settings = Settings(row_length=8, n_shards=3, seq_len=1)
    per_shard_files(spark, folder + "/in", TEXTS)
    Pipeline(spark, from_files(spark, folder + "/in"), settings, folder + "/out").ngrams(2)
    files = {f: t for f, t in written(folder + "/out").items() if "/samples/" in f}
    assert {f.split("shard=")[1][0] for f in files} == {"0", "1", "2"}
    # The same texts in another order leave the token table as it is.
    per_shard_files(spark, folder + "/in", {1: TEXTS[1][::-1]})
    encoded = []

    def encoding(documents, tokens):
        encoded.append(sorted(r.shard for r in documents.select("shard").distinct().collect()))
        return encode_documents(documents, tokens)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("foretoken.plans.pipeline.encode_documents", encoding)
        again = Pipeline(spark, from_files(spark, folder + "/in"), settings, folder + "/out")
        fresh = Pipeline(spark, from_files(spark, folder + "/in"), settings)
        assert sorted(again.samples().collect()) == sorted(fresh.samples().collect())
    assert encoded == [[1], [0, 1, 2]]
    kept = {f for f, t in written(folder + "/out").items() if files.get(f) == t}
    assert {f.split("shard=")[1][0] for f in kept} == {"0", "2"}
    assert sorted(again.ngrams(2).collect()) == sorted(fresh.ngrams(2).collect())
    assert again.encoded().count() == 24


def test_a_shard_that_goes_and_other_tokens(spark, folder):
    settings = Settings(row_length=8, n_shards=3, seq_len=1)
    per_shard_files(spark, folder + "/in", TEXTS)
    Pipeline(spark, from_files(spark, folder + "/in"), settings, folder + "/out").samples()
    # Too short for a row.
    per_shard_files(spark, folder + "/in", {1: ["x y"], 2: TEXTS[2]})
    again = Pipeline(spark, from_files(spark, folder + "/in"), settings, folder + "/out")
    fresh = Pipeline(spark, from_files(spark, folder + "/in"), settings)
    assert sorted(again.samples().collect()) == sorted(fresh.samples().collect())
    assert {r.shard for r in again.samples().collect()} == {0, 2}
    # A build that ended after its rows were written, before they were noted, is done again.
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("foretoken.plans.pipeline.require_complete", lambda *_: 1 / 0)
        per_shard_files(spark, folder + "/in", TEXTS)
        with pytest.raises(ZeroDivisionError):
            Pipeline(spark, from_files(spark, folder + "/in"), settings, folder + "/out").samples()
    last = Pipeline(spark, from_files(spark, folder + "/in"), settings, folder + "/out")
    whole = Pipeline(spark, from_files(spark, folder + "/in"), settings)
    assert sorted(last.samples().collect()) == sorted(whole.samples().collect())


def test_states_of_shards_come_from_one_job(spark, folder):
    per_shard_files(spark, folder, TEXTS)
    before = shard_states(from_files(spark, folder))
    spread = shard_states(read_documents(spark, f"{folder}/file*", 3))
    assert set(before) == {0, 1, 2} and spread == before
    per_shard_files(spark, folder, {2: ["z"]})
    after = shard_states(from_files(spark, folder))
    assert [s for s in before if before[s] != after[s]] == [2]
