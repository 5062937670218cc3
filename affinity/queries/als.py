"""Registered queries: recall by alternating least squares.

The factors have no SQL twin; which users, items and pairs they cover has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.operators import als, candidates, evaluate, ratings
from affinity.plans.staging import stage
from affinity.queries import inputs
from affinity.queries.sql import using
from affinity.sources import standins

K = 25
# Of the gradient's two parts; factors are kept in single precision.
TOLERANCE = 1e-3


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, als.AlsRecall]:
    """Order ratings, with more items than K, the held-out part, and a model of the rest."""
    rated = stage(standins.order_ratings(spark, sf_dir).withColumn("rating", F.col("rating").cast("double")), "bought")
    train, holdout = ratings.hash_split(rated)
    return rated, holdout, als.fit_als(train)


def als_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and item factors, one row per slot."""
    return als.factors(_fitted(spark, sf_dir)[2])


def als_factor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which users and items have factors, and of how many slots."""
    found = als_factors(spark, sf_dir).groupBy("side", "id")
    return found.agg(F.count("*").alias("slots"))


def als_predicted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which held-out pairs get a prediction."""
    return als_predictions(spark, sf_dir).select("uid", "aid")


def als_topk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items each user gets, and how many of them are distinct."""
    best = als_topk(spark, sf_dir).groupBy("uid")
    return best.agg(F.count("*").alias("n"), F.countDistinct("pred_aid").alias("items"))


def als_unseen_are_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of items that are still offered to the user who rated them: none."""
    offered = als_unseen_topk(spark, sf_dir).select("uid", F.col("pred_aid").alias("aid"))
    bought = standins.order_ratings(spark, sf_dir).select("uid", "aid")
    return bought.join(offered, ["uid", "aid"]).agg(F.count("*").alias("n"))


def als_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's factor is not negative, has no gradient where it is above 0, and
    none that would raise it where it is 0: the conditions of the least loss."""
    rated = stage(standins.order_ratings(spark, sf_dir).withColumn("rating", F.col("rating").cast("double")), "bought")
    train = ratings.hash_split(rated)[0]
    slots = als.optimality(als.fit_als(train), train)
    slope = (F.col("push") - F.col("pull")) / F.greatest(F.col("push") + F.col("pull"), F.lit(1e-12))
    free = F.col("value") > 0
    return slots.groupBy("uid").agg(
        F.count("*").alias("slots"),
        F.bool_and(F.col("value") >= 0).alias("nonnegative"),
        F.bool_and(~free | (F.abs(slope) < TOLERANCE)).alias("stationary"),
        F.bool_and(free | (slope > -TOLERANCE)).alias("bounded"),
    )


def als_predictions_are_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the prediction of each held-out pair is the product of its factors."""
    _, holdout, recall = _fitted(spark, sf_dir)
    predicted = als.factor_products(recall, als.predict(recall, holdout))
    agrees = F.abs(F.col("prediction") - F.col("product")) <= 1e-5 * F.greatest(F.lit(1.0), F.abs("product"))
    return predicted.select("uid", "aid", agrees.alias("agrees"))


def als_topk_are_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's scores are the products of their factors, best first."""
    recall = _fitted(spark, sf_dir)[2]
    best = als.topk_all(recall, K).withColumnRenamed("pred_aid", "aid")
    each = als.factor_products(recall, best)
    agrees = F.abs(F.col("pred_rating") - F.col("product")) <= 1e-5 * F.greatest(F.lit(1.0), F.abs("product"))
    return each.groupBy("uid").agg(F.count("*").alias("n"), F.bool_and(agrees).alias("agrees"))


def als_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, holdout, recall = _fitted(spark, sf_dir)
    return als.predict(recall, holdout)


def als_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return als.topk_all(_fitted(spark, sf_dir)[2], K)


def als_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best items for every user, by search, and how many items each user was multiplied with."""
    return als.topk_search(_fitted(spark, sf_dir)[2], K)


def als_search_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether, rank by rank, the search gives each user the scores of the solver's own top-k."""
    recall = _fitted(spark, sf_dir)[2]
    ranks = Window.partitionBy("uid").orderBy(F.desc("pred_rating"))
    own, found = (
        best.select("uid", F.row_number().over(ranks).alias("rank"), F.col("pred_rating").alias(name))
        for best, name in ((als.topk_solver(recall, K), "own"), (als.topk_search(recall, K), "found"))
    )
    near = F.abs(F.col("own") - F.col("found")) <= 1e-5 * F.greatest(F.lit(1.0), F.abs("own"))
    both = own.join(found, ["uid", "rank"], "full").groupBy("uid")
    return both.agg(F.count("*").alias("n"), F.bool_and(F.coalesce(near, F.lit(False))).alias("agrees"))


def als_topk_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best items for the customers of the last day with an order."""
    orders = standins.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), "o_orderdate")
    last = orders.agg(F.max("o_orderdate").alias("o_orderdate"))
    buyers = orders.join(F.broadcast(last), "o_orderdate")
    return als.topk_users(_fitted(spark, sf_dir)[2], buyers, K)


def als_unseen_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, _, recall = _fitted(spark, sf_dir)
    return als.unseen(als.topk_all(recall, K), rated)


def als_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rmse(als_predictions(spark, sf_dir), prediction="prediction")


def candidate_features_als(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.candidate_features(
        stage(als_unseen_topk(spark, sf_dir), "als"),
        inputs.article_vectors(spark, sf_dir),
        inputs.embeddings(spark, sf_dir),
        "pred_aid",
    )


QUERIES = {
    f.__name__: f
    for f in (
        als_factors, als_factor_ids, als_predictions, als_predicted_pairs, als_topk,
        als_topk_sizes, als_unseen_are_unseen, als_topk_subset, als_unseen_topk, als_rmse,
        candidate_features_als, als_optimality, als_predictions_are_products, als_topk_are_products,
        als_topk_search, als_search_agrees,
    )
}

_TRAIN = "SELECT * FROM order_ratings WHERE (uid * 31 + aid * 17) % 5 <> 0"

ORACLES = {
    "als_factor_ids": using(
        "order_ratings",
        select=f"""SELECT DISTINCT 'user' AS side, uid AS id, {als.RANK} AS slots FROM ({_TRAIN})
            UNION ALL SELECT DISTINCT 'item', aid, {als.RANK} FROM ({_TRAIN})""",
    ),
    "als_predicted_pairs": using(
        "order_ratings",
        select=f"""SELECT uid, aid FROM order_ratings WHERE (uid * 31 + aid * 17) % 5 = 0
            AND uid IN (SELECT uid FROM ({_TRAIN})) AND aid IN (SELECT aid FROM ({_TRAIN}))""",
    ),
    "als_topk_sizes": using(
        "order_ratings",
        select=f"""SELECT DISTINCT uid, {K} AS n, {K} AS items FROM ({_TRAIN})""",
    ),
    "als_unseen_are_unseen": "SELECT 0 AS n",
    "als_optimality": using(
        "order_ratings",
        select=f"""SELECT DISTINCT uid, {als.RANK} AS slots, TRUE AS nonnegative, TRUE AS stationary,
            TRUE AS bounded FROM ({_TRAIN})""",
    ),
    "als_predictions_are_products": using(
        "order_ratings",
        select=f"""SELECT uid, aid, TRUE AS agrees FROM order_ratings WHERE (uid * 31 + aid * 17) % 5 = 0
            AND uid IN (SELECT uid FROM ({_TRAIN})) AND aid IN (SELECT aid FROM ({_TRAIN}))""",
    ),
    "als_topk_are_products": using(
        "order_ratings", select=f"""SELECT DISTINCT uid, {K} AS n, TRUE AS agrees FROM ({_TRAIN})"""
    ),
    "als_search_agrees": using(
        "order_ratings", select=f"""SELECT DISTINCT uid, {K} AS n, TRUE AS agrees FROM ({_TRAIN})"""
    ),
}
