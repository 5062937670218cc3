"""Recalled candidates joined to features, and nested per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.plans.skew import split_join

# Narrow rows of one article or user widened by its vectors in one task.
WIDE_PER_TASK = 200_000


def article_side(vectors: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Articles that have both a base vector and an embedding."""
    return vectors.join(embeddings, "article_id")


def candidate_features(
    candidates: DataFrame,
    vectors: DataFrame,
    embeddings: DataFrame,
    item: str,
    most_per_task: int = WIDE_PER_TASK,
) -> DataFrame:
    """Candidates with the base vector and embedding of their article.

    The two article tables are joined first, so the larger candidate table moves
    once. Pass saved or staged candidates: their hot articles are counted.
    """
    articles = article_side(vectors, embeddings).withColumnRenamed("article_id", item)
    joined = split_join(candidates, articles, item, "uid", most_per_task, unique_right=True)
    return joined.select("uid", item, "pred_rating", "features", "article_vector")


def recommended_users(als: DataFrame, itemcf: DataFrame) -> DataFrame:
    """Users with candidates from either recall."""
    return als.select("uid").union(itemcf.select("uid")).distinct()


def recommended_user_features(
    als: DataFrame, itemcf: DataFrame, user_vectors: DataFrame
) -> DataFrame:
    """(uid, user_features) of users with candidates."""
    return recommended_users(als, itemcf).join(
        user_vectors.select("uid", F.col("features").alias("user_features")), "uid"
    )


def _nested(rows: DataFrame, item: str, payload: tuple[str, ...]) -> DataFrame:
    # Structs sort by their fields in order: best score first, then item id.
    entry = F.struct(
        (-F.col("pred_rating")).alias("order"), F.col(item).alias("aid"), *payload
    )
    ranked = rows.groupBy("uid").agg(F.sort_array(F.collect_list(entry)).alias("ranked"))
    return ranked.select(
        "uid",
        F.transform(
            "ranked",
            lambda r: F.struct(
                r.aid.alias("aid"),
                (-r.order).alias("rating"),
                *[r[name].alias(name) for name in payload],
            ),
        ).alias("recommendations"),
    )


def recommendation_lists(recommendations: DataFrame, item: str) -> DataFrame:
    """(uid, recommendations): each user's (aid, rating) pairs, best first.

    Takes the output of a top-k operator, which bounds every list by k.
    """
    return _nested(recommendations, item, ())


def candidate_lists(candidates: DataFrame, item: str) -> DataFrame:
    """Like :func:`recommendation_lists`, with both vectors in each entry."""
    return _nested(candidates, item, ("features", "article_vector"))
