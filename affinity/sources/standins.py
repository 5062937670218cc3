"""The input tables of the jobs, derived from the star-schema test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators.ratings import user_item_ratings
from affinity.sources import tables

# Parameters of the derived log: the day after its last event, and its action weights.
AS_OF = dt.date(2024, 1, 31)
WEIGHTS = {"click": 0.1, "view": 0.15, "signup": 0.2, "purchase": 0.3}
POSITIVE = ("click", "purchase")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def user_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a behaviour log; the article id sits in the JSON properties."""
    raw = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("uid"),
        F.get_json_object("props", "$.k").alias("aid"),
        F.col("event_type").alias("action"),
        F.date_format("ts", "yyyyMMdd").alias("action_date"),
    )
    return tables.scan_user_actions(raw)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-decayed ratings from the events."""
    return user_item_ratings(user_actions(spark, sf_dir), AS_OF, WEIGHTS)


def order_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger, sparser rating table: quantities of parts bought by customers."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"))
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("aid"), "l_quantity"
    )
    return (
        lines.join(orders, "o_orderkey")
        .groupBy("uid", "aid")
        .agg(F.sum("l_quantity").alias("rating"))
    )


def article_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as article facts; lines stand for images."""
    raw = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.col("n_chars").alias("article_num"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("img_num"),
        F.col("source").alias("type_name"),
        (F.col("doc_id") % 30).alias("pub_gap"),
    )
    return tables.scan_article_base(raw)


def user_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as user profiles; the nation stands for gender and mail provider."""
    customers = read(spark, sf_dir, "customer")
    nations = read(spark, sf_dir, "nation")
    raw = customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        F.col("c_custkey").alias("uid"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        F.floor(F.abs("c_acctbal") / 100).alias("age"),
        F.concat(F.lower("n_name"), F.lit(".com")).alias("email_suffix"),
    )
    return tables.scan_user_base(raw)


def article_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the word vectors of a hundred articles."""
    raw = read(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 100).alias("article_id"),
        F.concat(F.lit("t"), F.col("vec_id")).alias("top_term"),
        F.col("embedding").alias("vector"),
    )
    return tables.scan_article_terms(raw)


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per (uid, aid), labelled 1 after any click or purchase."""
    actions = user_actions(spark, sf_dir)
    raw = actions.groupBy("uid", "aid").agg(
        F.max(F.col("action").isin(*POSITIVE).cast("int")).alias("label")
    )
    return tables.scan_training(raw)
