"""Item-to-item cosine similarity from shared users."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from affinity.functions.sums import exact_sum, exact_unit_sum
from affinity.operators.cells import cell_sums, list_sums
from affinity.plans.skew import MOST_PER_TASK, hot_table, part_of, shuffle_partitions, split_join, tasks_for
from affinity.plans.staging import stage

# Items of one user that meet in one task.
ITEMS_PER_TILE = 2000

# Products from which on they are summed up cell by cell, if the items make many pairs, and
# the entries a cell holds.
CELLS_FROM = 2_000_000
ENTRIES_PER_CELL = 8_000_000
# How many products the index must save before its pairs are shuffled.
INDEX_SAVES = 8

# Steps of the order of users: for each doubling of their size, and by hash within one.
STEPS_PER_POWER, HASH_STEPS = 4, 64
# What rounding may take from a bound.
MARGIN = 1e-9


def _squares(ratings: DataFrame) -> DataFrame:
    """(aid, square): the sum of squares of each item's ratings."""
    square = exact_sum(F.col("rating") * F.col("rating")).alias("square")
    return ratings.where(F.col("rating") != 0).groupBy("aid").agg(square)


def item_norms(ratings: DataFrame) -> DataFrame:
    """Euclidean length of each item's rating column; zero columns are left out."""
    return _squares(ratings).select("aid", F.sqrt("square").alias("norm"))


def unit_columns(ratings: DataFrame) -> DataFrame:
    """(uid, aid, w, rating, square): ratings other than 0, with ``w`` scaled to a length of 1
    an item, and the item's sum of squares."""
    return ratings.where(F.col("rating") != 0).join(_squares(ratings), "aid").select(
        "uid", "aid", (F.col("rating") / F.sqrt("square")).alias("w"), "rating", "square"
    )


def item_similarity(
    ratings: DataFrame,
    items_per_tile: int = ITEMS_PER_TILE,
    most_per_task: int = MOST_PER_TASK,
) -> DataFrame:
    """Exact cosine of every two items rated by a common user, ``aid < sim_aid``.

    Pass staged ratings: they are read several times. Ratings are scaled to
    unit columns first, which keeps the norm join off the far larger pair table.
    A user with many items is cut into tiles of about ``items_per_tile`` by
    ``items_per_tile`` items, each joined on its own, so no task handles all
    pairs of a heavy user. Pairs run from the join into the map-side sum within
    one stage. Sums are exact in units of 2**-62, so a cosine below that is none.
    """
    products = pair_count(ratings)
    tiles = _cell_tiles(ratings, "rating", most_per_task, products)
    if tiles:
        return _tile_sums(unit_columns(ratings), tiles, products, ratings.count(), most_per_task)
    sizes = ratings.where(F.col("rating") != 0).groupBy("uid").agg(F.count("*").alias("n"))
    met = _meetings(unit_columns(ratings), sizes, items_per_tile, most_per_task)
    return (
        met.groupBy("aid", "sim_aid")
        .agg(exact_unit_sum(F.col("product")).alias("sim"))
        .where(F.col("sim") != 0)
    )


def _tile_sums(
    unit: DataFrame, tiles: int, products: float, entries: int, most_per_task: int, least: float | None = None
) -> DataFrame:
    """The sums by :func:`cell_sums` in so many tiles or, where that sends more copies of an
    entry, by :func:`list_sums`, whose copies are one for each product at most."""
    if tiles * entries <= products:
        return cell_sums(unit, tiles, least)
    return list_sums(unit, max(tiles, tasks_for(unit.sparkSession, products, most_per_task * 4), math.ceil(products / ENTRIES_PER_CELL)), least)


def _cell_tiles(ratings: DataFrame, value: str, most_per_task: int, pairs: float | None = None) -> int:
    """Tiles of items for :func:`cell_sums`; 0 where the map-side sums of a join do as well.

    They do while a task's products fall on a catalogue of few pairs. Elsewhere its sums are
    about as many as its products, and all of them would be shuffled.
    """
    if not all(isinstance(ratings.schema[name].dataType, IntegralType) for name in ("uid", "aid")):
        return 0
    pairs = pair_count(ratings, value) if pairs is None else pairs
    if pairs < CELLS_FROM:
        return 0
    items = ratings.select("aid").distinct().count()
    if items * (items - 1) / 2 < most_per_task / 4:
        return 0
    wanted = tasks_for(ratings.sparkSession, pairs, most_per_task * 4)
    return max(math.ceil(2 * ratings.count() / ENTRIES_PER_CELL), math.ceil((math.sqrt(8 * wanted + 1) - 1) / 2))


def _meetings(
    unit: DataFrame, sizes: DataFrame, items_per_tile: int, most_per_task: int, *carried: str
) -> DataFrame:
    """(aid, sim_aid, product) of every two items of a user, ``aid < sim_aid``, and the columns
    ``carried`` of one side and the other, as ``_a`` and ``_b``. ``sizes`` has each user's
    number of rows ``n``."""
    tiles = F.ceil(F.col("n") / F.lit(items_per_tile))
    most_tiles, pairs = sizes.agg(
        F.max(tiles), F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)
    ).first()

    if (most_tiles or 1) == 1:
        keys = ["uid"]
        left = right = unit
        ordered = F.col("a.aid") < F.col("b.aid")
    else:
        keys = ["uid", "tile_a", "tile_b"]
        hot = hot_table(sizes, "uid", tiles, "tiles")
        tiled = (
            unit.join(hot, "uid", "left")
            .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
            .withColumn("tile", part_of(F.col("aid"), F.col("tiles")))
        )
        # Tile pair (a, b) with a <= b; within a diagonal tile each pair once.
        left = tiled.select(
            "uid", "aid", "w", *carried, F.col("tile").alias("tile_a"),
            F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("tile_b"),
        )
        right = tiled.select(
            "uid", "aid", "w", *carried, F.explode(F.sequence(F.lit(0), "tile")).alias("tile_a"),
            F.col("tile").alias("tile_b"),
        )
        ordered = (F.col("a.tile_a") < F.col("a.tile_b")) | (F.col("a.aid") < F.col("b.aid"))

    tasks = tasks_for(unit.sparkSession, pairs or 0, most_per_task)
    if tasks > 1:
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    same_tile = [F.col(f"a.{key}") == F.col(f"b.{key}") for key in keys]
    met = left.alias("a").join(right.alias("b"), [*same_tile, ordered])
    return met.select(
        F.least("a.aid", "b.aid").alias("aid"),
        F.greatest("a.aid", "b.aid").alias("sim_aid"),
        (F.col("a.w") * F.col("b.w")).alias("product"),
        *(F.col(f"{side}.{name}").alias(f"{name}_{side}") for name in carried for side in "ab"),
    )


def index_entries(unit: DataFrame, least: float) -> DataFrame:
    """(uid, aid, w, before, rest): the entries of unit columns that two items must share to
    reach a similarity of ``least``.

    Users are put in one order, those with many items first, and each item leaves out its
    first users as long as their part is shorter than ``least``; ``rest`` is the length of
    that part, ``before`` that of all earlier users than the entry's. Two items that share no
    user both have kept share only users that the one with the later cut left out, and their
    similarity is at most that part's length. So the heaviest users, whose pairs are most of
    the work, mostly take no part. The order goes by steps of the users' sizes and a hash,
    and cuts fall between steps: an item has a bounded number of them, however many users.
    """
    sizes = unit.groupBy("uid").agg(F.count("*").alias("n"))
    step = -F.floor(F.log2("n") * STEPS_PER_POWER) * HASH_STEPS + F.pmod(F.xxhash64("uid"), F.lit(HASH_STEPS))
    placed = unit.join(sizes, "uid").select("uid", "aid", "w", step.alias("step"))
    parts = placed.groupBy("aid", "step").agg(F.sum(F.col("w") * F.col("w")).alias("part"))
    item = Window.partitionBy("aid")
    until = item.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    far = parts.withColumn("far", F.sum("part").over(until))
    out = F.col("far") < F.lit(least * least * (1 - MARGIN))
    lengths = far.select(
        "aid", "step", out.alias("out"),
        F.sqrt(F.greatest(F.col("far") - F.col("part"), F.lit(0.0))).alias("before"),
        F.sqrt(F.coalesce(F.max(F.when(out, F.col("far"))).over(item), F.lit(0.0))).alias("rest"),
    )
    return placed.join(lengths.where(~F.col("out")), ["aid", "step"]).select("uid", "aid", "w", "before", "rest")


def candidate_pairs(
    unit: DataFrame,
    least: float,
    items_per_tile: int = ITEMS_PER_TILE,
    most_per_task: int = MOST_PER_TASK,
) -> DataFrame:
    """(aid, sim_aid): all pairs that can be as similar as ``least``, and some that are not.

    A pair's similarity is at most the sum over the users both have kept and what the others
    can add: no more than the longer one of the parts left out, nor than the product of both
    lengths before the first user they share.
    """
    kept = stage(index_entries(unit, least), "indexed")
    sizes = kept.groupBy("uid").agg(F.count("*").alias("n"))
    met = _meetings(kept, sizes, items_per_tile, most_per_task, "before", "rest")
    sums = met.groupBy("aid", "sim_aid").agg(
        F.sum("product").alias("part"),
        F.max(F.greatest("rest_a", "rest_b")).alias("rest"),
        F.min(F.col("before_a") * F.col("before_b")).alias("before"),
    )
    most = F.col("part") + F.least("rest", "before")
    return sums.where(most >= least * (1 - MARGIN) - MARGIN).select("aid", "sim_aid")


def similarity_at_least(
    ratings: DataFrame,
    least: float,
    items_per_tile: int = ITEMS_PER_TILE,
    most_per_task: int = MOST_PER_TASK,
) -> DataFrame:
    """The rows of :func:`item_similarity` with ``sim >= least``, bit for bit. ``least`` lies
    above 0 and is at most 1; ratings are none below 0.

    Candidates come from :func:`candidate_pairs`, without the sums of the others. Each is then
    summed over the users of the one of its items that has fewer, looked up in the other.
    Every candidate is shuffled, and once more for each of these users. Where the products are
    many and the index saves few of them, :func:`cell_sums` sums all up without that, and only
    the pairs that are near leave its tasks. Pass staged ratings.
    """
    if not 0 < least <= 1:
        raise ValueError(f"least must lie above 0 and be at most 1, not {least}")
    unit = stage(unit_columns(ratings), "unit")
    products = pair_count(unit, "w")
    tiles = _cell_tiles(unit, "w", most_per_task, products)
    if tiles and products < INDEX_SAVES * pair_count(index_entries(unit, least), "w"):
        return _tile_sums(unit, tiles, products, unit.count(), most_per_task, least)
    pairs = stage(candidate_pairs(unit, least, items_per_tile, most_per_task), "candidates")
    users = unit.groupBy("aid").agg(F.count("*").alias("n"))
    sized = pairs.join(users, "aid").join(
        users.select(F.col("aid").alias("sim_aid"), F.col("n").alias("sim_n")), "sim_aid"
    )
    turned = F.col("n") > F.col("sim_n")
    near = sized.select(
        F.when(turned, F.col("sim_aid")).otherwise(F.col("aid")).alias("aid"),
        F.when(turned, F.col("aid")).otherwise(F.col("sim_aid")).alias("other"),
    )
    spread = split_join(unit, stage(near, "near"), "aid", "uid", most_per_task)
    looked_up = unit.select("uid", F.col("aid").alias("other"), F.col("w").alias("v"))
    return (
        spread.join(looked_up, ["uid", "other"])
        .groupBy(F.least("aid", "other").alias("aid"), F.greatest("aid", "other").alias("sim_aid"))
        .agg(exact_unit_sum(F.col("w") * F.col("v")).alias("sim"))
        .where(F.col("sim") >= least)
    )


def pair_count(ratings: DataFrame, value: str = "rating") -> float:
    """How many (user, item, item) combinations :func:`item_similarity` sums up."""
    sizes = ratings.where(F.col(value) != 0).groupBy("uid").agg(F.count("*").alias("n"))
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    return sizes.agg(F.sum(pairs)).first()[0] or 0.0


def staged_similarity(ratings: DataFrame) -> DataFrame:
    """:func:`item_similarity`, written with as many shuffle partitions as its pairs fill."""
    spark = ratings.sparkSession
    with shuffle_partitions(spark, tasks_for(spark, pair_count(ratings))):
        return stage(item_similarity(ratings), "similarity")


def symmetric(similarity: DataFrame) -> DataFrame:
    """Both directions of an upper-triangle similarity table."""
    mirror = similarity.select(
        F.col("sim_aid").alias("aid"), F.col("aid").alias("sim_aid"), "sim"
    )
    return similarity.select("aid", "sim_aid", "sim").unionByName(mirror)


def in_order(similarity: DataFrame) -> DataFrame:
    """All pairs by item and neighbour."""
    return similarity.orderBy("aid", "sim_aid")
