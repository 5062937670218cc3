from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from affinity.functions import rating as fn
from affinity.operators.ratings import hash_split, random_split, user_item_ratings
from affinity.sources import schemas

AS_OF = dt.date(2020, 7, 20)


def day(age: int) -> str:
    return (AS_OF - dt.timedelta(days=age)).strftime("%Y%m%d")


def rated(spark, rows):
    df = spark.createDataFrame(rows, "action string, d string")
    return [
        r.r for r in df.select(fn.action_rating(F.col("action"), F.col("d"), AS_OF).alias("r")).collect()
    ]


def test_single_precision_goldens(spark):
    got = rated(spark, [("点击", day(3)), ("收藏", day(3)), ("点赞", day(2))])
    assert got == [0.09002494812011719, 0.22506237030029297, 0.28577226400375366]


@pytest.mark.parametrize(
    "age, weight",
    [(-1, 0.99550372), (0, 0.99004817), (1, 0.97811872), (13, 0.00301842),
     (14, 0.00135852), (15, 0.00301842), (100, 0.00301842)],
)
def test_time_weight_by_age(spark, age, weight):
    df = spark.createDataFrame([(day(age),)], "d string")
    got = df.select(fn.time_weight(F.col("d"), AS_OF).alias("w")).first().w
    assert got == pytest.approx(weight, abs=1e-8)


def test_unknown_action_and_bad_date_weigh_nothing(spark):
    got = rated(spark, [("other", day(1)), (None, day(1)), ("点击", "20201399"), ("点击", None), ("点击", "x")])
    assert got == [0.0] * 5


def test_all_action_weights(spark):
    df = spark.createDataFrame([(a,) for a in fn.ACTION_WEIGHTS], "a string")
    got = {r.a: round(r.w, 6) for r in df.select("a", fn.action_weight(F.col("a")).alias("w")).collect()}
    assert got == fn.ACTION_WEIGHTS
    assert df.select(fn.action_weight(F.col("a"), {}).alias("w")).first().w == 0.0


def test_date_range(spark):
    df = spark.createDataFrame([("20200130", "20200202"), ("20200202", "20200130")], "s string, e string")
    got = [r.d for r in df.select(fn.date_range(F.col("s"), F.col("e")).alias("d")).collect()]
    assert got == [["20200130", "20200131", "20200201", "20200202"], ["20200202"]]


def test_ratings_sum_per_pair(spark):
    rows = [(1, 7, "点击", day(3)), (1, 7, "收藏", day(3)), (1, 8, "nothing", day(3))]
    df = spark.createDataFrame(rows, schemas.USER_ACTIONS)
    got = {(r.uid, r.aid): r.rating for r in user_item_ratings(df, AS_OF).collect()}
    assert got == {(1, 7): 0.09002494812011719 + 0.22506237030029297, (1, 8): 0.0}


@pytest.mark.parametrize("split", [hash_split, random_split])
def test_splits_are_disjoint_whole_and_repeatable(spark, split):
    big = 2**62
    pairs = spark.range(4000).select(
        (F.col("id") % 200 + big).alias("uid"), (F.col("id") * 7919 % 1009).alias("aid"),
        F.lit(1.0).alias("rating"),
    ).distinct()
    train, holdout = split(pairs)
    a = {(r.uid, r.aid) for r in train.collect()}
    b = {(r.uid, r.aid) for r in holdout.collect()}
    assert not a & b
    assert len(a | b) == pairs.count()
    assert {(r.uid, r.aid) for r in split(pairs.repartition(3))[0].collect()} == a
    assert 0.15 < len(b) / len(a | b) < 0.25
