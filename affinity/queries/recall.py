"""Registered queries: scans of the log, ratings, and item-based recall."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions import rating as fn
from affinity.operators import als, candidates, daily, evaluate, itemcf, ratings, similarity
from affinity.plans.staging import new_path, stage
from affinity.queries import inputs
from affinity.queries.inputs import rounded
from affinity.queries.sql import using
from affinity.sources import standins, tables

LIMIT = 1000
LEAST = {"events": 0.3, "orders": 0.2}
RATED_DAYS = (dt.date(2024, 1, 10), dt.date(2024, 1, 20), standins.AS_OF)
_DAYS = ", ".join(f"(DATE '{day}')" for day in RATED_DAYS)


def scan_user_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.user_actions(spark, sf_dir)


def scan_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a scan of at most :data:`LIMIT` rows of the log gives."""
    log = tables.open_table(spark, f"{sf_dir}/events.parquet", "parquet", LIMIT)
    return log.agg(F.count("*").alias("n"))


def action_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = fn.action_weight(F.col("action"), standins.WEIGHTS)
    return (
        standins.user_actions(spark, sf_dir)
        .select("uid", "aid", "action", weight.cast("double").alias("weight"))
        .transform(rounded, "weight")
    )


def time_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = fn.time_weight(F.col("action_date"), standins.AS_OF)
    return (
        standins.user_actions(spark, sf_dir)
        .select("uid", "aid", "action_date", weight.cast("double").alias("weight"))
        .transform(rounded, "weight")
    )


def days_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = fn.days_since(F.col("action_date"), standins.AS_OF)
    return standins.user_actions(spark, sf_dir).select(
        "uid", "aid", "action_date", days.alias("days")
    )


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day between a user's first and last action, and one day for the reverse."""
    spans = standins.user_actions(spark, sf_dir).groupBy("uid").agg(
        F.min("action_date").alias("first"), F.max("action_date").alias("last")
    )
    forward = fn.date_range(F.col("first"), F.col("last"))
    backward = fn.date_range(F.col("last"), F.col("first"))
    return spans.select("uid", F.lit("forward").alias("way"), F.explode(forward).alias("day")).union(
        spans.select("uid", F.lit("backward"), F.explode(backward))
    )


def action_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = ratings.rate_actions(
        standins.user_actions(spark, sf_dir), standins.AS_OF, standins.WEIGHTS
    )
    return rounded(rated.withColumn("rating", F.col("rating").cast("double")), "rating")


def user_item_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(standins.ratings(spark, sf_dir), "rating")


def ratings_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings for three days from one table of daily counts, written in two steps."""
    path = new_path(spark, "days")
    log = standins.user_actions(spark, sf_dir)
    daily.write_days(log.where(F.col("action_date") < "20240116"), path)
    counts = daily.write_days(log.where(F.col("action_date") >= "20240116"), path)
    parts = [
        daily.ratings_as_of(counts, day, standins.WEIGHTS).withColumn("as_of", F.lit(str(day)))
        for day in RATED_DAYS
    ]
    return rounded(reduce(DataFrame.unionByName, parts), "rating")


def rating_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ratings.sorted_ratings(standins.ratings(spark, sf_dir)), "rating")


def split_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, holdout = ratings.hash_split(standins.ratings(spark, sf_dir))
    both = train.withColumn("part", F.lit("training")).unionByName(
        holdout.withColumn("part", F.lit("holdout"))
    )
    return rounded(both, "rating")


def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, holdout = ratings.random_split(standins.ratings(spark, sf_dir))
    both = train.withColumn("part", F.lit("training")).unionByName(
        holdout.withColumn("part", F.lit("holdout"))
    )
    return rounded(both, "rating")


def item_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.item_norms(inputs.training(spark, sf_dir)), "norm")


def item_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.item_similarity(inputs.training(spark, sf_dir)), "sim")


def item_similarity_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = stage(standins.order_ratings(spark, sf_dir), "bought")
    return rounded(similarity.item_similarity(bought), "sim")


def item_similarity_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and parts that are alike, from a least similarity on."""
    bought = stage(standins.order_ratings(spark, sf_dir), "bought")
    logs = {"events": inputs.training(spark, sf_dir), "orders": bought}
    parts = [
        similarity.similarity_at_least(rated, LEAST[name]).withColumn("log", F.lit(name))
        for name, rated in logs.items()
    ]
    return rounded(reduce(DataFrame.unionByName, parts), "sim")


def similarity_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(itemcf.neighbours(inputs.training(spark, sf_dir)), "sim")


def similarity_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = itemcf.neighbours(inputs.training(spark, sf_dir))
    return rounded(similarity.in_order(both), "sim")


def rating_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = inputs.training(spark, sf_dir)
    joined = itemcf.rating_similarity_join(train, itemcf.neighbours(train))
    return rounded(joined, "rating", "sim", "rsp")


def cf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inputs.scores(spark, sf_dir)[1], "pred_rating")


def cf_unseen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, scored = inputs.scores(spark, sf_dir)
    # Staged, or the optimizer moves the anti join below the sums and shuffles what they take in.
    return rounded(itemcf.drop_seen(stage(scored, "scores"), train), "pred_rating")


def cf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best neighbours of each user's items, seen ones included."""
    scored = inputs.scores(spark, sf_dir)[1]
    best = itemcf.top_k(scored, inputs.K, score=F.round("pred_rating", inputs.DIGITS))
    return rounded(best, "pred_rating")


def itemcf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inputs.topk(spark, sf_dir), "pred_rating")


def itemcf_topk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best unseen items on the sparse order ratings, end to end."""
    bought = standins.order_ratings(spark, sf_dir).withColumn("rating", F.col("rating").cast("double"))
    best = itemcf.best_unseen_blocked(stage(bought, "bought"), inputs.K, inputs.DIGITS)
    return rounded(best, "pred_rating")


def cf_holdout_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out ratings looked up in the full score table."""
    train, holdout = inputs.split(spark, sf_dir)
    scored = itemcf.item_scores(itemcf.rating_similarity_join(train, itemcf.neighbours(train)))
    return rounded(itemcf.holdout_predictions(scored, holdout), "rating", "pred_rating")


def cf_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error over the hold-out ratings, scoring only those."""
    train, holdout = inputs.split(spark, sf_dir)
    predicted = itemcf.predict_holdout(train, holdout, itemcf.neighbours(train))
    return rounded(evaluate.rmse(predicted), "rmse")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.recommendation_lists(
        rounded(inputs.topk(spark, sf_dir), "pred_rating"), "sim_aid"
    )


def recommendation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested lists, shown as one row per list position."""
    return _lists(spark, sf_dir).select(
        "uid", F.posexplode("recommendations").alias("pos", "r")
    ).select("uid", "pos", F.col("r.aid").alias("aid"), F.col("r.rating").alias("rating"))


def explode_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return als.explode_recommendations(_lists(spark, sf_dir))


def anti_join_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ratings moved on by one item, without the items a user has rated."""
    rated = stage(standins.ratings(spark, sf_dir), "ratings")
    shifted = rated.select(
        "uid", (F.col("aid") + 1).alias("pred_aid"), F.col("rating").alias("pred_rating")
    )
    return rounded(als.unseen(shifted, rated), "pred_rating")


QUERIES = {
    f.__name__: f
    for f in (
        scan_user_action, scan_limited, action_weight, time_weight, days_since, date_range,
        action_rating, user_item_rating, ratings_as_of, rating_sorted, split_holdout, split_random, item_norms,
        item_similarity, item_similarity_orders, item_similarity_least, similarity_symmetric, similarity_preview,
        rating_similarity_join, cf_scores, cf_unseen_scores, cf_topk, itemcf_topk, itemcf_topk_orders,
        cf_holdout_predictions, cf_rmse, recommendation_lists, explode_recommendations,
        anti_join_seen,
    )
}

ORACLES = {
    "scan_user_action": using("actions", select="SELECT * FROM actions"),
    "scan_limited": f"SELECT least({LIMIT}, count(*)) AS n FROM events",
    "action_weight": using(
        "weighted",
        select="SELECT uid, aid, action, round(weight::DOUBLE, 6) AS weight FROM weighted",
    ),
    "time_weight": using(
        "timed",
        select="SELECT uid, aid, action_date, round(freshness::DOUBLE, 6) AS weight FROM timed",
    ),
    "days_since": using(
        "weighted",
        select="SELECT uid, aid, action_date, CAST(days AS INTEGER) AS days FROM weighted",
    ),
    "date_range": using(
        "actions",
        select="""SELECT uid, 'forward' AS way, strftime(day, '%Y%m%d') AS day FROM
            (SELECT uid, unnest(generate_series(strptime(min(action_date), '%Y%m%d'),
                    strptime(max(action_date), '%Y%m%d'), INTERVAL 1 DAY)) AS day
             FROM actions GROUP BY uid)
            UNION ALL SELECT uid, 'backward', max(action_date) FROM actions GROUP BY uid""",
    ),
    "action_rating": using(
        "rated",
        select="""SELECT uid, aid, action, action_date, round(rating::DOUBLE, 6) AS rating
                  FROM rated""",
    ),
    "user_item_rating": using(
        "ratings", select="SELECT uid, aid, round(rating, 6) AS rating FROM ratings"
    ),
    "ratings_as_of": using(
        "actions",
        select=f"""SELECT uid, aid, CAST(as_of AS VARCHAR) AS as_of,
                round(CAST(sum(weight * CAST(1 / (1 + exp(1 - (life - 7) * CAST(0.8 AS DOUBLE))) AS FLOAT))
                    AS DOUBLE), 6) AS rating
            FROM (SELECT *, CASE WHEN days > 14 THEN 1 ELSE 14 - days END AS life,
                      CAST(CASE action WHEN 'click' THEN 0.1 WHEN 'view' THEN 0.15
                           WHEN 'signup' THEN 0.2 WHEN 'purchase' THEN 0.3 ELSE 0 END AS FLOAT) AS weight
                  FROM (SELECT *, as_of - CAST(strptime(action_date, '%Y%m%d') AS DATE) AS days
                        FROM actions, (VALUES {_DAYS}) AS d(as_of)))
            WHERE days >= 0 GROUP BY uid, aid, as_of""",
    ),
    "rating_sorted": using(
        "ratings",
        select="SELECT uid, aid, round(rating, 6) AS rating FROM ratings ORDER BY uid DESC, aid",
    ),
    "split_holdout": using(
        "train", "holdout",
        select="""SELECT uid, aid, round(rating, 6) AS rating, 'training' AS part FROM train
            UNION ALL SELECT uid, aid, round(rating, 6), 'holdout' FROM holdout""",
    ),
    "split_random": using(
        "ratings",
        select="""SELECT uid, aid, round(rating, 6) AS rating,
                CASE WHEN CAST('0x' || substr(md5(uid || ':' || aid || ':17'), 1, 5) AS BIGINT) / 1048576.0 < 0.8
                     THEN 'training' ELSE 'holdout' END AS part FROM ratings""",
    ),
    "item_norms": using("norms", select="SELECT aid, round(norm, 6) AS norm FROM norms"),
    "item_similarity": using(
        "sim", select="SELECT aid, sim_aid, round(sim, 6) AS sim FROM sim"
    ),
    "item_similarity_orders": using(
        "order_ratings",
        select="""SELECT p.aid, p.sim_aid, round(p.dot / (x.norm * y.norm), 6) AS sim
            FROM (SELECT a.aid, b.aid AS sim_aid, sum(a.rating * b.rating) AS dot
                  FROM order_ratings a JOIN order_ratings b ON a.uid = b.uid AND a.aid < b.aid
                  GROUP BY a.aid, b.aid) p
            JOIN (SELECT aid, sqrt(sum(rating * rating)) AS norm FROM order_ratings
                  GROUP BY aid) x ON p.aid = x.aid
            JOIN (SELECT aid, sqrt(sum(rating * rating)) AS norm FROM order_ratings
                  GROUP BY aid) y ON p.sim_aid = y.aid""",
    ),
    "item_similarity_least": using(
        "sim", "order_sim",
        select=f"""SELECT aid, sim_aid, round(sim, 6) AS sim, 'events' AS log FROM sim
            WHERE sim >= {LEAST["events"]}
            UNION ALL SELECT aid, sim_aid, round(sim, 6), 'orders' FROM order_sim
            WHERE aid < sim_aid AND sim >= {LEAST["orders"]}""",
    ),
    "similarity_symmetric": using(
        "sym", select="SELECT aid, sim_aid, round(sim, 6) AS sim FROM sym"
    ),
    "similarity_preview": using(
        "sym",
        select="SELECT aid, sim_aid, round(sim, 6) AS sim FROM sym ORDER BY aid, sim_aid",
    ),
    "rating_similarity_join": using(
        "rsp",
        select="""SELECT uid, aid, round(rating, 6) AS rating, sim_aid, round(sim, 6) AS sim,
                         round(rsp, 6) AS rsp FROM rsp""",
    ),
    "cf_scores": using(
        "scores", select="SELECT uid, sim_aid, round(pred_rating, 6) AS pred_rating FROM scores"
    ),
    "cf_unseen_scores": using(
        "unseen", select="SELECT uid, sim_aid, round(pred_rating, 6) AS pred_rating FROM unseen"
    ),
    "cf_topk": using(
        "scores",
        select="""SELECT uid, sim_aid, round(pred_rating, 6) AS pred_rating,
                         CAST(rank AS INTEGER) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY uid
                            ORDER BY round(pred_rating, 6) DESC, sim_aid) AS rank FROM scores)
            WHERE rank <= 25""",
    ),
    "itemcf_topk": using(
        "topk",
        select="""SELECT uid, sim_aid, round(pred_rating, 6) AS pred_rating,
                         CAST(rank AS INTEGER) AS rank FROM topk""",
    ),
    "itemcf_topk_orders": using(
        "order_scores",
        select="""SELECT uid, sim_aid, round(pred_rating, 6) AS pred_rating,
                         CAST(rank AS INTEGER) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY uid
                            ORDER BY round(pred_rating, 6) DESC, sim_aid) AS rank
                  FROM order_scores s WHERE NOT EXISTS
                  (SELECT 1 FROM order_ratings t WHERE t.uid = s.uid AND t.aid = s.sim_aid))
            WHERE rank <= 25""",
    ),
    "cf_holdout_predictions": using(
        "predicted",
        select="""SELECT uid, aid, round(rating, 6) AS rating,
                         round(pred_rating, 6) AS pred_rating FROM predicted""",
    ),
    "cf_rmse": using(
        "predicted",
        select="""SELECT round(sqrt(avg((rating - pred_rating) * (rating - pred_rating))), 6)
                         AS rmse FROM predicted""",
    ),
    "recommendation_lists": using(
        "topk",
        select="""SELECT uid, CAST(rank - 1 AS INTEGER) AS pos, sim_aid AS aid,
                         round(pred_rating, 6) AS rating FROM topk""",
    ),
    "explode_recommendations": using(
        "topk",
        select="""SELECT uid, sim_aid AS pred_aid, round(pred_rating, 6) AS pred_rating
                  FROM topk""",
    ),
    "anti_join_seen": using(
        "ratings",
        select="""SELECT r.uid, r.aid + 1 AS pred_aid, round(r.rating, 6) AS pred_rating
            FROM ratings r WHERE NOT EXISTS
            (SELECT 1 FROM ratings s WHERE s.uid = r.uid AND s.aid = r.aid + 1)""",
    ),
}
