from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from affinity.plans import prefix, skew, staging


def test_staging_uses_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert staging.shared_dir(spark) == folder
    staged = staging.stage(spark.range(5).withColumn("s", F.lit("x")), "five")
    assert staged.count() == 5
    assert all(folder in name for name in staged.inputFiles())


def test_clear_removes_what_was_staged(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    staged = staging.stage(spark.range(3))
    assert staged.count() == 3 and list(tmp_path.iterdir())
    staging.clear(spark)
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("per_task", [3, 20, 10_000])
def test_split_join_equals_join(spark, per_task, unique):
    rng = random.Random(2)
    left = [(rng.choice([1, 1, 1, 2, 3]), i) for i in range(60)]
    right = [(k, j) for k in (1, 2, 9) for j in range(1 if unique else 4)]
    ldf = spark.createDataFrame(left, "k bigint, l bigint")
    rdf = spark.createDataFrame(right, "k bigint, r bigint")
    joined = skew.split_join(ldf, rdf, "k", "l", per_task, unique_right=unique)
    got = sorted(map(tuple, joined.collect()))
    assert joined.columns == ["k", "l", "r"]
    assert got == sorted((k, x, y) for k, x in left for k2, y in right if k == k2)


def test_a_hot_key_is_split_on_both_sides(spark):
    left = spark.range(500).select(F.lit(7).alias("k"), F.col("id").alias("l"))
    right = spark.range(20_000).select(F.lit(7).alias("k"), F.col("id").alias("r"))
    joined = skew.split_join(left, right, "k", "l", most_per_task=100_000)
    sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 10_000_000
    assert len(sizes) >= 100 and max(r["count"] for r in sizes) <= 100_000


def test_hot_table_holds_only_split_keys(spark):
    sizes = spark.createDataFrame([(1, 10), (2, 3)], "k bigint, n bigint")
    hot = skew.hot_table(sizes, "k", F.ceil(F.col("n") / 4), "parts")
    assert hot.collect() == [(1, 3)]


def test_shuffle_partitions_follow_the_work(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)

    def written():
        plan = spark.range(9).groupBy((F.col("id") % 3).alias("k")).count()
        return plan._jdf.queryExecution().executedPlan().toString()

    with skew.shuffle_partitions(spark, 123):
        assert ", 123)" in written()
    with skew.shuffle_partitions(spark, 1):
        assert spark.conf.get(name) == before
    assert spark.conf.get(name) == before


def test_tasks_follow_the_work(spark):
    assert skew.tasks_for(spark, 0) == 1
    assert skew.tasks_for(spark, 250_000) == 3
    assert skew.tasks_for(spark, 10**6) == spark.sparkContext.defaultParallelism
    assert skew.tasks_for(spark, 10**10) == 2000


@pytest.mark.parametrize("n, buckets", [(0, 4), (0, None), (1, 4), (2, None), (500, 7), (500, 256)])
def test_running_total_equals_plain_sum(spark, n, buckets):
    rng = random.Random(n)
    keys = rng.sample(range(-10_000, 10_000), n)
    rows = [(key / 7, rng.randrange(5)) for key in keys]
    df = spark.createDataFrame(rows, "x double, v bigint")
    got = {r.x: r.below for r in prefix.running_total(df, "x", "v", "below", buckets).collect()}
    expected, total = {}, 0
    for x, v in sorted(rows):
        expected[x] = total
        total += v
    assert got == expected


def test_running_total_with_clustered_keys(spark):
    keys = [1e-12 * i for i in range(200)] + [1e12, float("inf"), -5.0]
    df = spark.createDataFrame([(k, 1) for k in keys], "x double, v bigint")
    got = {r.x: r.below for r in prefix.running_total(df, "x", "v", "below", 16).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_running_total_keeps_a_null_as_the_first(spark):
    rows = [(None, 3), (1.0, 2), (2.0, 5)]
    df = spark.createDataFrame(rows, "x double, v bigint")
    got = {r.x: r.below for r in prefix.running_total(df, "x", "v", "below", 4).collect()}
    assert got == {None: 0, 1.0: 3, 2.0: 5}


def test_dense_index_of_wide_ids(spark):
    ids = [2**60 + i * 3 for i in range(50)] + [-7, 0, 5]
    df = spark.createDataFrame([(i,) for i in ids * 2], "uid bigint")
    got = {r.uid: r.idx for r in prefix.dense_index(df, "uid").collect()}
    assert got == {uid: i for i, uid in enumerate(sorted(ids))}
