"""Inputs the registered queries share, each derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators import embedding, features, itemcf, ratings
from affinity.plans.staging import stage
from affinity.sources import standins

K = itemcf.TOP_K
DIGITS = 6


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with doubles rounded, so that two engines agree on them."""
    return df.withColumns({name: F.round(name, DIGITS) for name in columns})


def slots(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, slot, value) rows of an array column."""
    return rounded(df.select(key, F.posexplode(vector).alias("slot", "value")), "value")


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out ratings, staged once."""
    return ratings.hash_split(stage(standins.ratings(spark, sf_dir), "ratings"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged training ratings."""
    return stage(ratings.hash_split(standins.ratings(spark, sf_dir))[0], "training")


def scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training ratings and the score of every reachable pair."""
    train = training(spark, sf_dir)
    rated = itemcf.rating_similarity_join(train, itemcf.neighbours(train))
    return train, itemcf.item_scores(rated)


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k recommendations, ranked on the rounded score so that ties fall alike."""
    return itemcf.best_unseen(
        training(spark, sf_dir), K, score=F.round("pred_rating", DIGITS)
    )


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User base vectors."""
    return features.user_features(standins.user_base(spark, sf_dir))


def article_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article base vectors."""
    return features.article_features(standins.article_base(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article embeddings."""
    return embedding.article_embedding(standins.article_terms(spark, sf_dir))
