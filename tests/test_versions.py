import pytest

from foretoken.plans.pipeline import Pipeline, published
from foretoken.session import list_folder
from foretoken.settings import Settings
from foretoken.sources.documents import read_documents
from foretoken.sources.tables import write_chunked, write_table
from foretoken.sources.versions import LIVE, live_number, live_path, new_folder, read_live, replace, switch


def numbers(spark, n):
    return spark.range(n).selectExpr("cast(id as int) as id0", "id as count")


def put(spark, path, n):
    replace(spark, path, lambda new: write_table(numbers(spark, n), new))


def test_the_last_write_is_read(spark, folder):
    for n in (5, 7, 3):
        put(spark, folder + "/t", n)
        assert read_live(spark, folder + "/t").count() == n
    assert live_number(spark, folder + "/t") == 3


def test_a_write_that_fails_half_way_changes_nothing(spark, folder):
    path = folder + "/t"
    put(spark, path, 5)

    def half(new):
        write_table(numbers(spark, 9), new)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        replace(spark, path, half)
    assert read_live(spark, path).count() == 5

    def broken(new):
        failing = numbers(spark, 9).selectExpr("id0", "if(id0 = 8, raise_error('lost'), count) as count")
        write_chunked(failing, new, 4)

    with pytest.raises(Exception, match="lost"):
        replace(spark, path, broken)
    assert sorted(r.id0 for r in read_live(spark, path).collect()) == list(range(5))


def test_who_began_to_read_may_finish_and_older_folders_go(spark, folder):
    path = folder + "/t"
    put(spark, path, 5)
    reading = read_live(spark, path)
    put(spark, path, 7)
    assert reading.count() == 5
    put(spark, path, 8)
    put(spark, path, 9)
    assert len([f for f in list_folder(spark, path) if f.startswith("v-")]) == 2
    assert sorted(list_folder(spark, f"{path}/{LIVE}")) == ["3", "4"]


def test_two_writers_do_not_overwrite_each_other(spark, folder):
    path = folder + "/t"
    put(spark, path, 5)
    seen = live_number(spark, path)
    put(spark, path, 6)
    with pytest.raises(RuntimeError, match="another writer"):
        switch(spark, path, seen, new_folder(), lambda state: [state])
    assert read_live(spark, path).count() == 6


def test_a_plain_folder_and_no_folder(spark, folder):
    write_table(numbers(spark, 4), folder + "/plain")
    assert live_path(spark, folder + "/plain") == folder + "/plain"
    with pytest.raises(FileNotFoundError):
        read_live(spark, folder + "/none")


def test_a_publication_is_replaced_as_a_whole(spark, folder):
    documents = read_documents(spark, "/root/testdata/sf0.001/documents.parquet", 2)
    settings = Settings(row_length=64, n_shards=2, seq_len=1, min_trigram_count=3)
    names = Pipeline(spark, documents.where("doc_id < 20"), settings).publish(folder + "/out")
    first = published(spark, folder + "/out", names)
    before = first["ngrams_2"].count()
    whole = Pipeline(spark, documents, settings)

    def stopped(*_):
        raise KeyboardInterrupt

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(whole, "scan_filter", stopped)
        with pytest.raises(KeyboardInterrupt):
            whole.publish(folder + "/out")
    assert published(spark, folder + "/out", names)["ngrams_2"].count() == before
    whole.publish(folder + "/out")
    assert published(spark, folder + "/out", names)["ngrams_2"].count() == whole.ngrams(2).count() > before
    assert first["ngrams_2"].count() == before
