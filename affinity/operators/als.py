"""Recall by alternating least squares on implicit feedback."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators.itemcf import drop_seen
from affinity.operators.search import best_products
from affinity.plans.prefix import dense_index
from affinity.plans.skew import tasks_for
from affinity.plans.staging import drop_unused, scratch_path, shared_dir, stage

# Solver settings.
RANK = 16
MAX_ITER = 6
REG = 0.01
ALPHA = 1.0

# Every user block exchanges with every item block: a factor is sent to each block that rates
# it, so the traffic grows with the blocks until every rating sends one. Blocks stay as few as
# the cores and the memory of a task allow: a rating takes 8 bytes and at most one received factor
# of 80, and an id's factor is received once, however many ratings it has.
RATINGS_PER_BLOCK = 12_000_000
MOST_BLOCKS = 4000
_RATING_BYTES, _FACTOR_BYTES = 8, 80


class AlsRecall(NamedTuple):
    """A fitted model with the numbering of its users (uid, user) and items (aid, item)."""

    model: ALSModel
    users: DataFrame
    items: DataFrame


def _numbering(ratings: DataFrame, column: str, name: str) -> DataFrame:
    """Every id with the solver's int for it, whatever the id's size."""
    numbered = dense_index(ratings, column, name)
    return stage(numbered.withColumn(name, F.col(name).cast("int")), name)


def _encoded(rows: DataFrame, recall: AlsRecall) -> DataFrame:
    """Rows with the solver's ``user`` and ``item`` numbers; unknown ids drop out."""
    for column, numbers in (("uid", recall.users), ("aid", recall.items)):
        if column in rows.columns:
            rows = rows.join(numbers, column)
    return rows


def solver_blocks(spark: SparkSession, ratings: int, ids: int) -> int:
    """Blocks of either factor matrix for so many ratings, and ids on the side that has more."""
    room = RATINGS_PER_BLOCK * (_RATING_BYTES + _FACTOR_BYTES) - ids * _FACTOR_BYTES
    per_block = max(RATINGS_PER_BLOCK, room // _RATING_BYTES)
    return min(MOST_BLOCKS, tasks_for(spark, ratings, per_block))


def fit_als(
    training: DataFrame,
    rank: int = RANK,
    max_iter: int = MAX_ITER,
    reg: float = REG,
    blocks: int | None = None,
    seed: int = 17,
) -> AlsRecall:
    """Non-negative implicit-feedback factors. Pass staged ratings.

    ``blocks`` cuts each factor matrix; by default their number follows the ratings. The
    model is written and read back: the fitted one would hold on to the shuffles of all
    iterations, which its factors could be computed again from.
    """
    spark = training.sparkSession
    maps = AlsRecall(None, _numbering(training, "uid", "user"), _numbering(training, "aid", "item"))
    if blocks is None:
        blocks = solver_blocks(spark, training.count(), max(maps.users.count(), maps.items.count()))
    solver = ALS(
        userCol="user",
        itemCol="item",
        ratingCol="rating",
        rank=rank,
        maxIter=max_iter,
        regParam=reg,
        alpha=ALPHA,
        implicitPrefs=True,
        nonnegative=True,
        coldStartStrategy="drop",
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        seed=seed,
    )
    if max_iter > solver.getCheckpointInterval():
        shared_dir(spark)
    path = scratch_path(spark, "model")
    solver.fit(_encoded(training, maps)).write().save(path)
    drop_unused(spark)
    return maps._replace(model=ALSModel.load(path))


def predict(recall: AlsRecall, ratings: DataFrame) -> DataFrame:
    """Ratings with the model's ``prediction``; unknown users or items drop out."""
    predicted = recall.model.transform(_encoded(ratings, recall))
    return predicted.select(*ratings.columns, F.col("prediction").cast("double"))


def explode_recommendations(nested: DataFrame) -> DataFrame:
    """(uid, array of (aid, rating)) to one row per recommended item."""
    return nested.select("uid", F.explode("recommendations").alias("r")).select(
        "uid",
        F.col("r.aid").alias("pred_aid"),
        F.col("r.rating").cast("double").alias("pred_rating"),
    )


def _decoded(recall: AlsRecall, nested: DataFrame) -> DataFrame:
    pairs = F.transform(
        "recommendations", lambda r: F.struct(r.item.alias("aid"), r.rating.alias("rating"))
    )
    rows = explode_recommendations(
        nested.select(F.col("user").alias("uid"), pairs.alias("recommendations"))
    )
    for column, key, name, numbers in (
        ("uid", "uid", "user", recall.users),
        ("pred_aid", "aid", "item", recall.items),
    ):
        back = numbers.select(F.col(name).alias(column), F.col(key).alias("_id"))
        rows = rows.join(back, column).withColumn(column, F.col("_id")).drop("_id")
    return rows.select(
        F.col("uid").cast("bigint"), F.col("pred_aid").cast("bigint"), "pred_rating"
    )


def _vectors(recall: AlsRecall, side: str, out: str) -> DataFrame:
    """(uid, ``out``) or (aid, ``out``): the factors of one side by their own ids."""
    table, numbers, key = {
        "user": (recall.model.userFactors, recall.users, "uid"), "item": (recall.model.itemFactors, recall.items, "aid"),
    }[side]
    return table.withColumnRenamed("id", side).join(numbers, side).select(key, F.col("features").alias(out))


def _dot(x: str, y: str) -> Column:
    terms = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def factors(recall: AlsRecall) -> DataFrame:
    """(side, id, slot, value) of every user and item factor, by their own ids."""
    sides = [
        _vectors(recall, side, "features").select(
            F.lit(side).alias("side"), F.col(key).alias("id"), F.posexplode("features").alias("slot", "value")
        )
        for side, key in (("user", "uid"), ("item", "aid"))
    ]
    return sides[0].unionByName(sides[1])


def optimality(recall: AlsRecall, training: DataFrame, reg: float = REG, alpha: float = ALPHA) -> DataFrame:
    """(uid, slot, value, pull, push): how far each user factor is from the least loss.

    The solver's last step sets the user factors for fixed item factors. At the least
    non-negative loss the gradient, ``push - pull``, is 0 in slots above 0, and not negative
    in slots at 0. With ``c = alpha * |rating|`` for a user's own ratings, ``push`` is what
    all items, the own ones once more by ``c``, and the penalty make of the factor; ``pull``
    is the sum of the positively rated items, each by ``1 + c``. The penalty is ``reg`` for
    each positive rating. ``training`` is the table the model was fitted on.
    """
    slots = range(recall.model.rank)
    items, users = _vectors(recall, "item", "y"), _vectors(recall, "user", "x")
    # One row of rank * rank sums, whatever the number of items.
    y = [F.col("y")[i].cast("double") for i in slots]
    held = items.agg(*[F.sum(y[i] * y[j]).alias(f"{i}_{j}") for i in slots for j in slots]).first()
    gram = [[float(held[f"{i}_{j}"]) for j in slots] for i in slots]

    # Factors travel in single precision, an item's with each of its ratings; as the vectors are
    # what is hashed, ratings are not sorted. Sums alone keep a user's rows out of a sort, too.
    rated = training.select("uid", "aid", "rating").join(items.hint("shuffle_hash"), "aid").drop("aid")
    met = rated.join(users.hint("shuffle_hash"), "uid")
    c = alpha * F.abs("rating")
    liked = F.when(F.col("rating") > 0, 1 + c).otherwise(0.0)
    own = met.select("uid", "y", (c * _dot("x", "y")).alias("again"), liked.alias("liked"))
    sums = own.groupBy("uid").agg(
        F.sum(F.when(F.col("liked") > 0, reg).otherwise(0.0)).alias("penalty"),
        *[F.sum(F.col("again") * y[i]).alias(f"again_{i}") for i in slots],
        *[F.sum(F.col("liked") * y[i]).alias(f"pull_{i}") for i in slots],
    )
    summed = sums.join(users, "uid").withColumns({
        "x": F.col("x").cast("array<double>"),
        "again": F.array(*[f"again_{i}" for i in slots]),
        "pull": F.array(*[f"pull_{i}" for i in slots]),
    })

    def push(i: int) -> Column:
        shared = sum((F.col("x")[j] * gram[i][j] for j in slots), F.lit(0.0))
        return shared + F.col("again")[i] + F.col("penalty") * F.col("x")[i]

    each = F.array(*[F.struct(F.lit(i).alias("slot"), F.col("x")[i].alias("value"), F.col("pull")[i].alias("pull"), push(i).alias("push")) for i in slots])
    return summed.select("uid", F.inline(each))


def factor_products(recall: AlsRecall, pairs: DataFrame) -> DataFrame:
    """``pairs`` (uid, aid, ...) with ``product``, the scalar product of their factors."""
    # The vectors are what is hashed, so that pairs, of which there may be many, are not sorted.
    users, items = (_vectors(recall, *side).hint("shuffle_hash") for side in (("user", "_x"), ("item", "_y")))
    met = pairs.join(users, "uid").join(items, "aid")
    return met.select(*pairs.columns, _dot("_x", "_y").alias("product"))


def topk_all(recall: AlsRecall, k: int) -> DataFrame:
    """The ``k`` best items for every user, seen ones included: those of :func:`topk_search`,
    with scores added up in single precision, as the solver does."""
    return _found(recall, k).select("uid", "pred_aid", F.col("single").cast("double").alias("pred_rating"))


def topk_solver(recall: AlsRecall, k: int) -> DataFrame:
    """:func:`topk_all` by the solver, which multiplies every user with every item."""
    return _decoded(recall, recall.model.recommendForAllUsers(k))


def topk_search(recall: AlsRecall, k: int) -> DataFrame:
    """The ``k`` best items for every user by search: exact, equal scores by id, and most pairs
    never multiplied. ``multiplied`` is the number of items whose product with the user was computed."""
    return _found(recall, k).select("uid", "pred_aid", F.col("score").alias("pred_rating"), "multiplied")


def _found(recall: AlsRecall, k: int) -> DataFrame:
    """The search's rows, by the ids of users and items: both go along with the vectors, so the
    rows found need no join. Equal scores rank by id, as they do by the solver's number."""
    users, items = (
        _vectors(recall, side, "vector").select(F.col(key).cast("bigint").alias(side), "vector")
        for side, key in (("user", "uid"), ("item", "aid"))
    )
    return best_products(users, items, k).select(
        F.col("user").alias("uid"), F.col("item").alias("pred_aid"), "score", "single", "multiplied"
    )


def topk_users(recall: AlsRecall, users: DataFrame, k: int) -> DataFrame:
    """The ``k`` best items for the given users, seen ones included."""
    chosen = _encoded(users.select("uid").distinct(), recall)
    return _decoded(recall, recall.model.recommendForUserSubset(chosen, k))


def unseen(recommendations: DataFrame, ratings: DataFrame) -> DataFrame:
    """Recommendations without items the user has rated; a user may keep fewer than k."""
    # Ratings are what is hashed; neither side is sorted.
    return drop_seen(recommendations, ratings.hint("shuffle_hash"), "pred_aid")
