from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from affinity.operators import als
from affinity.plans.skew import tasks_for
from affinity.sources import schemas
from test_itemcf import RATINGS, invented


@pytest.fixture(scope="module")
def recall(spark):
    return als.fit_als(invented(spark), rank=4, blocks=2)


def test_factors_are_not_negative(recall):
    for factors in (recall.model.userFactors, recall.model.itemFactors):
        assert factors.select(F.min(F.array_min("features"))).first()[0] >= 0


def test_topk_bounds_and_unseen(spark, recall):
    ratings = invented(spark)
    top = als.topk_all(recall, 5)
    assert top.schema.simpleString() == "struct<uid:bigint,pred_aid:bigint,pred_rating:double>"
    assert set(Counter(r.uid for r in top.collect()).values()) == {5}
    seen = {(r.uid, r.aid) for r in ratings.collect()}
    left = als.unseen(top, ratings).collect()
    assert left and not seen & {(r.uid, r.pred_aid) for r in left}


def test_chosen_users(spark, recall):
    users = spark.createDataFrame([(12,), (12,), (14,), (99,)], "uid bigint")
    assert Counter(r.uid for r in als.topk_users(recall, users, 3).collect()) == {12: 3, 14: 3}


def test_predictions_drop_unknown_ids(spark, recall):
    rows = [(11, 1, 5.0), (11, 999, 1.0), (77, 1, 1.0), (2**40, 1, 1.0)]
    got = als.predict(recall, spark.createDataFrame(rows, schemas.RATINGS)).collect()
    assert [(r.uid, r.aid, r.rating) for r in got] == [(11, 1, 5.0)]


def test_wide_ids_are_numbered_and_restored(spark, recall):
    shift = 2**50
    wide = invented(spark).select(
        (F.col("uid") * shift).alias("uid"), (F.col("aid") * shift).alias("aid"), "rating"
    )
    fitted = als.fit_als(wide, rank=4, blocks=2)
    assert fitted.users is not None and fitted.items is not None
    got = als.topk_all(fitted, 6)
    assert {r.uid // shift for r in got.collect()} == set(range(11, 18))
    assert {r.pred_aid // shift for r in got.collect()} == set(range(1, 7))
    assert als.predict(fitted, wide).count() == len(RATINGS)
    chosen = als.topk_users(fitted, spark.createDataFrame([(12 * shift,)], "uid bigint"), 2)
    assert [r.uid for r in chosen.collect()] == [12 * shift, 12 * shift]


def by_id(recall):
    table = als.factors(recall).orderBy("side", "id", "slot").collect()
    out = {}
    for r in table:
        out.setdefault((r.side, r.id), []).append(r.value)
    return out


@pytest.mark.parametrize("shift", [1, 2**50])
def test_predictions_are_dot_products_and_topk_the_best_of_them(spark, shift):
    ratings = invented(spark).select(
        (F.col("uid") * shift).alias("uid"), (F.col("aid") * shift).alias("aid"), "rating"
    )
    fitted = als.fit_als(ratings, rank=4, blocks=2)
    factors = by_id(fitted)
    users, items = ([i for side, i in factors if side == name] for name in ("user", "item"))
    assert set(users) == {u * shift for u, _, _ in RATINGS} and set(items) == {a * shift for _, a, _ in RATINGS}

    def dot(uid, aid):
        return sum(x * y for x, y in zip(factors["user", uid], factors["item", aid]))

    for r in als.predict(fitted, ratings).collect():
        assert r.prediction == pytest.approx(dot(r.uid, r.aid), abs=1e-5)
    best = {}
    for r in als.topk_all(fitted, 3).collect():
        best.setdefault(r.uid, []).append(r.pred_rating)
    for uid in users:
        expected = sorted((dot(uid, aid) for aid in items), reverse=True)[:3]
        assert sorted(best[uid], reverse=True) == pytest.approx(expected, abs=1e-5)


def test_topk_is_the_solver_s_without_every_pair(spark, recall, monkeypatch):
    # Which of the items with equal scores end a list is the solver's choice.
    def rows(best):
        return sorted((r.uid, r.pred_rating) for r in best.collect())

    own = rows(als.topk_solver(recall, 4))
    monkeypatch.setattr(type(recall.model), "recommendForAllUsers", None)
    assert own and rows(als.topk_all(recall, 4)) == own


def test_blocks_stay_as_few_as_cores_and_memory_allow(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 30e6, als.RATINGS_PER_BLOCK) == cores
    assert tasks_for(spark, 2.4e9, als.RATINGS_PER_BLOCK) == 200


def worst(slots):
    """The largest violation of the conditions of the least loss, relative to the gradient's parts."""
    out = 0.0
    for r in slots.collect():
        slope = (r.push - r.pull) / max(r.push + r.pull, 1e-12)
        out = max(out, abs(slope) if r.value > 0 else -slope, -r.value)
    return out


def test_user_factors_are_optimal(spark, recall):
    rows = [*RATINGS, (18, 1, 0.0), (18, 2, 2.0), (19, 3, -1.5), (19, 1, 1.0)]
    ratings = spark.createDataFrame(rows, schemas.RATINGS)
    fitted = als.fit_als(ratings, rank=4, blocks=2)
    slots = als.optimality(fitted, ratings)
    assert slots.count() == 4 * 9
    assert worst(slots) < 1e-4
    assert worst(als.optimality(fitted, ratings, reg=0.5)) > 1e-2
    assert worst(als.optimality(fitted, ratings, alpha=1.1)) > 1e-3
    assert worst(als.optimality(fitted, ratings.where("aid != 1"))) > 1e-2


def test_a_factor_is_received_once_however_many_blocks_there_could_be(spark):
    """172.6 million ratings fit the memory of as many blocks as there are cores."""
    cores = spark.sparkContext.defaultParallelism
    assert als.solver_blocks(spark, 172_600_000, 7_200_000) == cores
    assert als.solver_blocks(spark, 2_400_000_000, 1_000_000_000) == 200


def test_the_model_holds_no_shuffle_of_the_fit(recall):
    for table in (recall.model.userFactors, recall.model.itemFactors):
        assert table.inputFiles()
        assert "ShuffledRowRDD" not in table.rdd.toDebugString().decode()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_found_rows_are_not_joined_and_checked_ones_not_sorted(spark, recall):
    top = als.topk_all(recall, 3)
    assert "Join" not in plan_of(top)
    pairs = top.withColumnRenamed("pred_aid", "aid")
    for df, joins in ((als.factor_products(recall, pairs), 2), (als.optimality(recall, invented(spark)), 2)):
        assert plan_of(df).count("ShuffledHashJoin") >= joins and "SortAggregate" not in plan_of(df)
    assert "ShuffledHashJoin" in plan_of(als.unseen(top, invented(spark)))


def test_ids_below_zero_are_found(spark):
    ratings = invented(spark).select((-F.col("uid")).alias("uid"), (F.col("aid") - 3).alias("aid"), "rating")
    fitted = als.fit_als(ratings, rank=4, blocks=2)
    best = als.topk_all(fitted, 6)
    assert {r.pred_aid for r in best.collect()} == set(range(-2, 4))
    for r in als.factor_products(fitted, best.withColumnRenamed("pred_aid", "aid")).collect():
        assert r.product == pytest.approx(r.pred_rating, abs=1e-5)
