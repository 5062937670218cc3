"""Ratings of items by users, from the behaviour log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.functions.rating import (
    ACTION_WEIGHTS,
    AGING_DAYS,
    action_weight,
    days_since,
    freshness,
)
from affinity.functions.sums import exact_sum


def rate_actions(
    actions: DataFrame,
    as_of: dt.date,
    weights: Mapping[str, float] = ACTION_WEIGHTS,
    aging_days: int = AGING_DAYS,
) -> DataFrame:
    """The log with a ``rating`` per action.

    The age is a column of its own, so that each date is parsed once.
    """
    aged = actions.withColumn("days", days_since(F.col("action_date"), as_of))
    rating = action_weight(F.col("action"), weights) * freshness(F.col("days"), aging_days)
    return aged.select("uid", "aid", "action", "action_date", rating.alias("rating"))


def user_item_ratings(
    actions: DataFrame,
    as_of: dt.date,
    weights: Mapping[str, float] = ACTION_WEIGHTS,
    aging_days: int = AGING_DAYS,
) -> DataFrame:
    """One row per (uid, aid): the exact sum of its action ratings as double."""
    rated = rate_actions(actions, as_of, weights, aging_days)
    return rated.groupBy("uid", "aid").agg(exact_sum(F.col("rating")).alias("rating"))


def sorted_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings by user id, largest first."""
    return ratings.orderBy(F.desc("uid"), F.asc("aid"))


def hash_bucket(buckets: int) -> Column:
    """Bucket of a (uid, aid) pair; the same on every run and every engine."""
    return F.pmod(
        F.pmod(F.col("uid"), F.lit(buckets)) * 31 + F.pmod(F.col("aid"), F.lit(buckets)) * 17,
        F.lit(buckets),
    )


def hash_split(ratings: DataFrame, buckets: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out ratings; one bucket in ``buckets`` is held out."""
    bucket = hash_bucket(buckets)
    return ratings.where(bucket != 0), ratings.where(bucket == 0)


def random_split(
    ratings: DataFrame, training: float = 0.8, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out ratings drawn at random with a fixed seed.

    The draw hashes the pair with the seed rather than counting rows, so a recomputed
    partition gives the same split; it is the first five digits of an MD5, so any engine does.
    """
    text = F.concat_ws(":", F.col("uid").cast("string"), F.col("aid").cast("string"), F.lit(str(seed)))
    digits = F.substring(F.md5(text.cast("binary")), 1, 5)
    draw = F.conv(digits, 16, 10).cast("bigint") / F.lit(1 << 20)
    return ratings.where(draw < training), ratings.where(draw >= training)
