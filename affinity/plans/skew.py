"""Joins whose keys may be hot on both sides.

Adaptive execution splits a join partition by its bytes. A many-to-many join
needs more: a hot key of modest size on each side still multiplies into a huge
number of result rows. These helpers split such keys by their result rows
instead, and change nothing about the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.plans.staging import stage

# Result rows of a join per task: enough to be worth a task, and the most for one.
LEAST_PER_TASK = 100_000
MOST_PER_TASK = 5_000_000

# Cells a task's worth of a hot key is cut into, so that tasks that get several of them by
# chance stay near the mean.
CELLS_PER_TASK = 8


def tasks_for(spark: SparkSession, rows: float, most_per_task: int = MOST_PER_TASK) -> int:
    """Tasks for a step that produces ``rows`` rows, however small its input is.

    All cores once there is enough work for them, more tasks beyond that.
    """
    cores = min(spark.sparkContext.defaultParallelism, math.ceil(rows / LEAST_PER_TASK))
    return max(1, cores, math.ceil(rows / most_per_task))


@contextmanager
def shuffle_partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """At least so many shuffle partitions for what is run inside: a sum over pairs has as
    many rows as the join below it makes, whatever the size of its input."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), least)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def part_of(value: Column, parts: Column) -> Column:
    """Stable part number in ``[0, parts)`` for a value."""
    return F.pmod(F.xxhash64(value), parts.cast("bigint")).cast("int")


def hot_table(sizes: DataFrame, key: str, parts: Column, out: str) -> DataFrame:
    """Keys to be split and into how many parts.

    Staged, so that joins against it are planned from its written size:
    broadcast when small, shuffled when not.
    """
    counted = sizes.select(key, parts.cast("int").alias(out))
    return stage(counted.where(F.col(out) > 1), f"hot-{key}")


def split_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    most_per_task: int = MOST_PER_TASK,
    sized_by: DataFrame | None = None,
    unique_right: bool = False,
) -> DataFrame:
    """Inner join on ``key`` with the work of hot keys spread over several tasks.

    A key that yields more than ``most_per_task`` rows is cut on both sides, by
    hashes of ``spread_by`` on the left and of the other columns on the right.
    Each left part meets each right part in a cell of its own; the sides are cut
    in proportion to their sizes, which copies the fewest rows. Left keys are
    counted first, in ``sized_by`` when left derives from that cheaper table, so
    pass tables that are cheap to read again. ``unique_right`` says that right
    holds each key once, so only the left is cut.
    """
    counted = left if sized_by is None else sized_by
    sizes = counted.groupBy(key).agg(F.count("*").alias("_left"))
    if unique_right:
        sizes = sizes.withColumn("_right", F.lit(1).cast("bigint"))
    else:
        sizes = sizes.join(right.groupBy(key).agg(F.count("*").alias("_right")), key)
    rows = F.col("_left").cast("double") * F.col("_right")
    sizes = stage(sizes.withColumn("_rows", rows), f"sizes-{key}")
    cells = F.ceil(F.col("_rows") * (1 if unique_right else CELLS_PER_TASK) / most_per_task)
    total, most = sizes.agg(F.sum("_rows"), F.max("_rows")).first()

    keys = [key]
    if (most or 0) > most_per_task:
        keys = [key, "_a", "_b"]
        cut = F.ceil(F.sqrt(F.col("_cells") * F.col("_left") / F.col("_right")))
        hot = (
            sizes.where(F.col("_rows") > most_per_task)
            .withColumn("_cells", cells)
            .withColumn("_as", F.least("_left", F.greatest(F.lit(1), cut)))
            .withColumn("_bs", F.least("_right", F.ceil(F.col("_cells") / F.col("_as"))))
            .select(key, F.col("_as").cast("int"), F.col("_bs").cast("int"))
        )
        rest = [F.col(c) for c in right.columns if c != key]
        one_a, one_b = F.coalesce("_as", F.lit(1)), F.coalesce("_bs", F.lit(1))
        left = (
            left.join(hot, key, "left")
            .withColumn("_a", part_of(F.col(spread_by), one_a))
            .withColumn("_b", F.explode(F.sequence(F.lit(0), one_b - 1)))
            .drop("_as", "_bs")
        )
        right = (
            right.join(hot, key, "left")
            .withColumn("_b", F.pmod(F.xxhash64(*rest), one_b.cast("bigint")).cast("int"))
            .withColumn("_a", F.explode(F.sequence(F.lit(0), one_a - 1)))
            .drop("_as", "_bs")
        )
    if not unique_right:
        tasks = tasks_for(left.sparkSession, total or 0, most_per_task)
        if len(keys) > 1:
            tasks = max(tasks, math.ceil(CELLS_PER_TASK / 2 * total / most_per_task))
        if tasks > 1:
            left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.join(right, keys).drop("_a", "_b")


def sent_join(left: DataFrame, right: DataFrame, key: str, kept_by: str, most_per_task: int = MOST_PER_TASK) -> DataFrame:
    """Inner join on ``key`` with a small ``right`` sent whole to every task of ``left``.

    Left rows are dealt by ``kept_by`` into as many tasks as the joined rows fill, and stay
    there: a sum by ``kept_by`` and other columns that follows is complete, or nearly so,
    before anything is shuffled, however many rows the join makes of one.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_left")).join(
        right.groupBy(key).agg(F.count("*").alias("_right")), key
    )
    total = counts.agg(F.sum(F.col("_left").cast("double") * F.col("_right"))).first()[0]
    tasks = tasks_for(left.sparkSession, total or 0, most_per_task)
    if tasks > 1:
        left = left.repartition(tasks, kept_by)
    return left.join(F.broadcast(right), key)
