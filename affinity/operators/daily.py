"""Ratings for any day, from a table of action counts by day instead of the log.

The decay depends on the day a rating is asked for, so ratings themselves cannot be kept.
What they need of the log is how often a user took an action on an item on a day. That is
kept as Parquet by day: a new day's log rewrites its own folder, and a rating run reads the
days up to its own and no log.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions.rating import (
    ACTION_WEIGHTS,
    AGING_DAYS,
    DATE_PATTERN,
    action_weight,
    freshness,
)
from affinity.functions.sums import exact_sum
from affinity.plans.staging import stage
from affinity.sources import schemas

KEYS = ("uid", "aid", "action", "day")


def daily_counts(actions: DataFrame) -> DataFrame:
    """(uid, aid, action, n, day): how often each occurs in the log.

    An unreadable date has a null day and counts 0: it weighs nothing, but its item is seen.
    """
    days = actions.withColumn("day", F.try_to_date("action_date", DATE_PATTERN))
    number = F.when(F.col("day").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    counts = days.withColumn("n", number).groupBy(*KEYS).agg(F.sum("n").alias("n"))
    return counts.select("uid", "aid", "action", "n", "day")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`write_days` keeps at ``path``."""
    return spark.read.schema(schemas.DAILY_COUNTS).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_days(actions: DataFrame, path: str, merge: bool = False) -> DataFrame:
    """Put the days of a log into the table at ``path`` and return the table.

    The log holds whole days: each day in it replaces that day's folder, so writing it again
    changes nothing. With ``merge`` it holds late rows, which are added to what the table has
    of their days. Other days are neither read nor written. Rows without a readable date are
    added to the earlier ones in both cases.
    """
    spark = actions.sparkSession
    new = stage(daily_counts(actions), "daily")
    if _exists(spark, path):
        # One value for each day of the log.
        days = [row.day for row in new.select("day").distinct().collect()]
        again = F.col("day").isNull() if None in days else F.lit(False)
        if merge:
            again = again | F.col("day").isin([day for day in days if day is not None])
        old = stage(read_days(spark, path).where(again), "daily-old")
        both = new.unionByName(old).groupBy(*KEYS).agg(F.sum("n").alias("n"))
        new = both.select("uid", "aid", "action", "n", "day")
    spread = new.hint("rebalance", F.col("day"))
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)
    return read_days(spark, path)


def ratings_as_of(
    counts: DataFrame,
    as_of: dt.date,
    weights: Mapping[str, float] = ACTION_WEIGHTS,
    aging_days: int = AGING_DAYS,
) -> DataFrame:
    """One row per (uid, aid) of the days up to ``as_of``: the ratings its log would give."""
    known = counts.where(F.col("day").isNull() | (F.col("day") <= F.lit(as_of)))
    days = F.datediff(F.lit(as_of), F.col("day"))
    rating = action_weight(F.col("action"), weights) * freshness(days, aging_days)
    rated = known.select("uid", "aid", rating.alias("rating"), "n")
    return rated.groupBy("uid", "aid").agg(exact_sum(F.col("rating"), F.col("n")).alias("rating"))
