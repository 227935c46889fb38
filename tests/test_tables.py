import glob

import pytest
from pyspark.sql import functions as F

from foretoken.operators.control import (
    FINISHED,
    all_shards,
    build_pending_shards,
    missing,
    pending,
    read_manifest,
    require_complete,
)
from foretoken.operators.ngrams import ngram_counts, ngram_partials, recombine
from foretoken.operators.packing import pack_wrap
from foretoken.sources.documents import read_conversations, read_documents, shard_range
from foretoken.sources.samples import (
    batch_fits_a_task,
    cap_batches,
    cap_per_shard,
    gather_batches,
    read_samples,
    spread_samples,
    write_samples,
)
from foretoken.sources.tables import (
    read_chunks,
    read_partials,
    union_chunks,
    write_chunked,
    write_partials,
    write_ranked,
    write_table,
)


def files(path):
    return glob.glob(path + "/**/*.parquet", recursive=True)


@pytest.fixture
def counts(spark):
    return spark.range(2000).select(
        (F.col("id") % 200).cast("int").alias("id0"),
        F.col("id").cast("int").alias("id1"),
        F.lit(1).cast("bigint").alias("count"),
    )


def test_one_file_per_small_chunk(spark, folder, counts):
    write_chunked(counts, folder, 64)
    assert len(files(folder)) == 64
    assert read_chunks(spark, folder).count() == 2000


def test_large_chunk_is_split(spark, folder):
    hot = spark.range(60000).select(
        F.lit(5).alias("id0"), F.xxhash64("id").cast("string").alias("pad"), F.col("id").alias("id1")
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        write_chunked(hot.repartition(8), folder, 64)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(files(folder)) > 1
    assert read_chunks(spark, folder, 5).count() == 60000


def test_one_chunk_reads_one_folder(spark, folder, counts):
    write_chunked(counts, folder, 64)
    one = read_chunks(spark, folder, 3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(id0_chunk" in plan
    assert {r.id0 % 64 for r in one.select("id0").distinct().collect()} == {3}
    assert len(one.inputFiles()) >= 1


def test_chunks_put_together(spark, folder, counts):
    write_chunked(counts, folder, 8)
    whole = union_chunks([read_chunks(spark, folder, i) for i in range(8)])
    assert sorted(whole.collect()) == sorted(read_chunks(spark, folder).collect())


def test_writing_again_replaces(spark, folder, counts):
    write_table(counts, folder)
    write_table(counts.limit(10), folder)
    assert spark.read.parquet(folder).count() == 10


def test_counting_a_batch_again_does_not_double(spark, folder, samples_of):
    samples = samples_of([[1, 2, 3]] * 4)
    for _ in range(2):
        write_partials(ngram_partials(samples, 2, 2, 8), folder)
    write_partials(ngram_partials(samples.where("sample >= 2"), 2, 2, 8), folder)
    assert spark.read.parquet(folder).agg(F.sum("count")).first()[0] == 8


def test_a_rerun_batch_with_fewer_chunks_leaves_none_behind(spark, folder, samples_of):
    write_partials(ngram_partials(samples_of([[1, 2, 3, 4]]), 2, 2, 8), folder)
    write_partials(ngram_partials(samples_of([[1, 2]]), 2, 2, 8), folder)
    assert spark.read.parquet(folder).agg(F.sum("count")).first()[0] == 1


def test_a_batch_has_one_folder(spark, folder, samples_of):
    rows = [[k, k + 1, k + 2, k + 3, 60 - k] for k in range(40)]
    write_partials(ngram_partials(samples_of(rows), 2, 4, 64), folder)
    assert len(files(folder)) == 10
    read = spark.read.parquet(folder)
    assert read.select("batch").distinct().count() == 10 and "id0_chunk" in read.columns
    assert read.agg(F.sum("count")).first()[0] == 160


def test_rows_are_spread_over_tasks_of_so_many_ids(spark, folder, samples_of, monkeypatch):
    write_samples(samples_of([[k] * 8 for k in range(256)]), folder)
    samples = read_samples(spark, folder)
    assert spread_samples(samples, 8).rdd.getNumPartitions() == samples.rdd.getNumPartitions()
    monkeypatch.setattr("foretoken.sources.samples.TASK_IDS", 64)
    monkeypatch.setattr("foretoken.sources.samples.RUN_IDS", 16)
    spread = spread_samples(samples, 8)
    assert spread.rdd.getNumPartitions() == 32
    assert max(map(len, spread.rdd.glom().collect())) < 64
    assert sorted(spread.collect()) == sorted(samples.collect())


def test_counts_of_gathered_batches_do_not_move(spark, folder, samples_of):
    both = samples_of([[k, k + 1, k + 2, 60 - k] for k in range(40)]).unionByName(
        samples_of([[k, 7, k + 2] for k in range(30)], shard=1)
    )
    write_samples(both, folder + "/samples")
    samples = read_samples(spark, folder + "/samples")
    gathered = gather_batches(samples, 4, 4)
    counted = ngram_partials(gathered, 2, 4, 8)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(counted.collect()) == sorted(ngram_partials(both, 2, 4, 8).collect())
    write_partials(counted, folder + "/partials", gathered=True)
    read = read_partials(spark, folder + "/partials")
    assert len(files(folder + "/partials")) == 10
    assert sorted(recombine(read, 2).collect()) == sorted(ngram_counts(both, 2).collect())


def test_whether_a_batch_fits_a_task():
    assert batch_fits_a_task(128, 256, 4)
    assert not batch_fits_a_task(2048, 1 << 17, 1650)


def test_ranks_of_a_sorted_table(spark, folder):
    table = spark.range(5000).selectExpr("cast(hash(id) % 100 as int) as a", "id").repartition(7)
    ranked = write_ranked(table.orderBy(F.desc("a"), "id"), folder)
    got = [(r.a, r.id) for r in ranked.orderBy("rank").collect()]
    assert got == sorted(((r.a, r.id) for r in table.collect()), key=lambda r: (-r[0], r[1]))
    assert ranked.agg(F.max("rank"), F.countDistinct("rank")).first() == (5000, 5000)
    assert write_ranked(table.where("false").orderBy("id"), folder).count() == 0


def test_samples_come_back(spark, folder, encoded_of):
    samples = pack_wrap(encoded_of({0: [9, 9, 30], 2: [40]}), 8)
    write_samples(samples, folder)
    assert sorted(read_samples(spark, folder).collect()) == sorted(samples.collect())
    plan = read_samples(spark, folder).where("shard = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan


def test_caps(encoded_of):
    samples = pack_wrap(encoded_of({0: [80], 1: [24]}), 8)
    assert cap_per_shard(samples, 4).count() == 7
    assert cap_per_shard(samples, None).count() == 13
    got = cap_batches(samples, 2, 2).collect()
    assert len(got) == 7 and {r.batch for r in got} == {0, 1}
    assert {r.batch for r in cap_batches(samples, 4, None).collect()} == {0, 1, 2}


def test_shard_ranges(spark):
    rows = all_shards(spark, 6)
    pick = lambda *a: sorted(r.shard for r in shard_range(rows, 6, *a).collect())
    assert pick() == [0, 1, 2, 3, 4, 5]
    assert pick(2, 4) == [2, 3]
    assert pick(4, 99) == [4, 5]


def test_missing_shard_is_named(spark):
    present = spark.createDataFrame([(0,), (1,), (1,), (3,)], "shard int")
    assert [r.shard for r in missing(all_shards(spark, 4), present).collect()] == [2]
    with pytest.raises(ValueError, match=r"1 missing from shard, first of them \[2\]"):
        require_complete(all_shards(spark, 4), present)
    assert require_complete(all_shards(spark, 2), present) is present


def test_only_pending_shards_are_built(spark, folder, encoded_of):
    documents = encoded_of({0: [16], 1: [24], 2: [8]})
    paths = (folder + "/samples", folder + "/manifest")
    seen = []

    def build(part):
        seen.append(sorted(r.shard for r in part.select("shard").distinct().collect()))
        return pack_wrap(part, 8)

    spark.createDataFrame([(1, FINISHED), (2, "started")], "shard int, status string").write.parquet(
        paths[1]
    )
    assert build_pending_shards(documents, build, *paths, n_shards=3) == 2
    assert seen == [[0, 2]]
    assert build_pending_shards(documents, build, *paths, n_shards=3) == 0
    assert pending(all_shards(spark, 3), read_manifest(spark, paths[1])).count() == 0
    assert {r.shard for r in read_samples(spark, paths[0]).collect()} == {0, 2}


def test_sources(spark):
    sf = "/root/testdata/sf0.001"
    documents = read_documents(spark, f"{sf}/documents.parquet", 4)
    assert documents.columns == ["shard", "doc_id", "text"]
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    turns = read_conversations(spark, f"{sf}/conversations.parquet", 4)
    assert turns.count() == turns.select("doc_id").distinct().count()


def test_any_turn_of_any_conversation_has_a_number(spark, folder):
    rows = [(1, (1 << 20) + 5, "b"), (2, 5, "c"), (1, 0, "a"), (1 << 44, 1, "d")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").write.parquet(folder + "/c")
    turns = read_conversations(spark, folder + "/c", 4).orderBy("doc_id").collect()
    assert [r.text for r in turns] == ["a", "b", "c", "d"]
    assert len({r.doc_id for r in turns}) == 4


def test_an_interrupted_build_goes_on(spark, folder, encoded_of):
    documents = encoded_of({k: [16] for k in range(5)})
    paths = (folder + "/samples", folder + "/manifest")
    build = lambda part: pack_wrap(part, 8)
    assert build_pending_shards(documents, build, *paths, 5, shards_per_job=2, jobs=1) == 2
    left = pending(all_shards(spark, 5), read_manifest(spark, paths[1])).collect()
    assert sorted(r.shard for r in left) == [2, 3, 4]
    assert build_pending_shards(documents, build, *paths, 5, shards_per_job=2) == 3
    assert {r.shard for r in read_samples(spark, paths[0]).collect()} == set(range(5))


def test_counts_have_partial_and_final_step(samples_of):
    plan = ngram_counts(samples_of([[1, 2]]), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "partial_count" in plan
    assert plan.count("Exchange") == 1
