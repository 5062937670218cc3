"""Recall by item-based collaborative filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.functions.sums import exact_sum
from affinity.operators.blocked import tile_candidates
from affinity.operators.similarity import staged_similarity, symmetric
from affinity.plans.skew import MOST_PER_TASK, sent_join, split_join

TOP_K = 25
JOB_TOP_K = 100

# Rows of a similarity table that is sent whole to the ratings; some 60 MB in memory.
MOST_SENT = 1_000_000


def rating_similarity_join(
    ratings: DataFrame,
    similarity: DataFrame,
    most_per_task: int = MOST_PER_TASK,
    most_sent: int = MOST_SENT,
) -> DataFrame:
    """Each rating beside each neighbour of its item, with ``rsp = rating * sim``.

    Pass staged tables: their keys are counted first. With up to ``most_sent`` similarities
    the rows of a user stay together, so that the sums by user and item that follow shuffle
    a row for each score, not for each joined row; beyond that, items are met by shuffling.
    """
    if similarity.count() <= most_sent:
        joined = sent_join(ratings, similarity, "aid", "uid", most_per_task)
    else:
        joined = split_join(ratings, similarity, "aid", "uid", most_per_task)
    return joined.select(
        "uid", "aid", "rating", "sim_aid", "sim", (F.col("rating") * F.col("sim")).alias("rsp")
    )


def _weighted_mean() -> Column:
    return F.try_divide(exact_sum(F.col("rsp")), exact_sum(F.col("sim"))).alias("pred_rating")


def item_scores(rated_similarity: DataFrame) -> DataFrame:
    """Similarity-weighted mean rating per (uid, sim_aid)."""
    return rated_similarity.groupBy("uid", "sim_aid").agg(_weighted_mean())


def drop_seen(scores: DataFrame, ratings: DataFrame, item: str = "sim_aid") -> DataFrame:
    """Scores of items the user has no rating for, not even a zero one."""
    seen = ratings.select("uid", F.col("aid").alias(item))
    return scores.join(seen, ["uid", item], "left_anti")


def unseen_scores(rated_similarity: DataFrame, ratings: DataFrame) -> DataFrame:
    """:func:`item_scores` then :func:`drop_seen`, in the one shuffle of the scores.

    Seen pairs enter the aggregate as marker rows. An anti join on top of it
    would be pushed below it by the optimizer and cost the map-side sums.
    """
    seen = ratings.select(
        "uid", F.col("aid").alias("sim_aid"), F.lit(None).cast("double").alias("rsp"),
        F.lit(None).cast("double").alias("sim"), F.lit(True).alias("seen"),
    )
    scored = rated_similarity.select("uid", "sim_aid", "rsp", "sim", F.lit(False).alias("seen"))
    merged = scored.unionByName(seen).groupBy("uid", "sim_aid").agg(
        _weighted_mean(), F.bool_or("seen").alias("seen")
    )
    return merged.where(~F.col("seen")).drop("seen")


def top_k(
    scores: DataFrame, k: int = TOP_K, item: str = "sim_aid", score: Column | None = None
) -> DataFrame:
    """The ``k`` best items per user; equal scores rank by item id.

    The rank filter is pushed below the shuffle, so each map task sends at most
    ``k`` rows per user.
    """
    best = F.col("pred_rating") if score is None else score
    order = Window.partitionBy("uid").orderBy(best.desc(), F.col(item).asc())
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def holdout_predictions(scores: DataFrame, holdout: DataFrame) -> DataFrame:
    """Held-out ratings beside their prediction, where there is one."""
    predicted = scores.select("uid", F.col("sim_aid").alias("aid"), "pred_rating")
    return holdout.join(predicted, ["uid", "aid"]).where(F.col("pred_rating").isNotNull())


def predict_holdout(
    training: DataFrame,
    holdout: DataFrame,
    similarity: DataFrame,
    most_per_task: int = MOST_PER_TASK,
) -> DataFrame:
    """:func:`holdout_predictions` without scoring any pair that is not held out.

    Held-out items meet only the training items of their own user.
    """
    wanted = holdout.select("uid", F.col("aid").alias("sim_aid"), F.col("rating").alias("actual"))
    pairs = split_join(training, wanted, "uid", "aid", most_per_task)
    near = pairs.join(similarity, ["aid", "sim_aid"]).withColumn(
        "rsp", F.col("rating") * F.col("sim")
    )
    scored = near.groupBy("uid", "sim_aid", "actual").agg(_weighted_mean())
    return scored.where(F.col("pred_rating").isNotNull()).select(
        "uid", F.col("sim_aid").alias("aid"), F.col("actual").alias("rating"), "pred_rating"
    )


def neighbours(training: DataFrame) -> DataFrame:
    """Similarity of training ratings in both directions.

    It is the costliest part, and its written size decides the joins that follow.
    The pairs are staged once and mirrored where they are read.
    """
    return symmetric(staged_similarity(training))


def best_unseen(
    training: DataFrame,
    k: int = JOB_TOP_K,
    score: Column | None = None,
    similarity: DataFrame | None = None,
) -> DataFrame:
    """Top-k unseen items per user, end to end from staged training ratings."""
    similarity = neighbours(training) if similarity is None else similarity
    rated = rating_similarity_join(training, similarity)
    return top_k(unseen_scores(rated, training), k, score=score)


def best_unseen_blocked(
    training: DataFrame, k: int = JOB_TOP_K, digits: int | None = None, similarity: DataFrame | None = None
) -> DataFrame:
    """:func:`best_unseen` for a large catalogue: scores are summed tile by tile, and at most
    ``k`` rows a user and tile are shuffled. Ranks by the score rounded to ``digits``, if given.

    ``similarity`` holds each pair once, as :func:`staged_similarity` gives it.
    """
    similarity = staged_similarity(training) if similarity is None else similarity
    score = F.col("pred_rating") if digits is None else F.round("pred_rating", digits)
    return top_k(tile_candidates(training, similarity, k, digits), k, score=score)
