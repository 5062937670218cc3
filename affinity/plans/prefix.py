"""Running totals over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.plans.skew import tasks_for
from affinity.plans.staging import stage

ROWS_PER_BUCKET = 1_000_000


def running_total(
    df: DataFrame, order: str, value: str, out: str, buckets: int | None = None
) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` over all rows with a smaller ``order``.

    ``order`` must be a number and unique; null comes before all numbers. Rows are cut into value ranges at
    approximate quantiles; each range is summed on its own window and shifted by
    the total of the ranges below. The cut points only balance the work, so the
    result is exact. The number of ranges follows the number of rows.
    """
    df = stage(df, "running")
    if buckets is None:
        buckets = tasks_for(df.sparkSession, df.count(), ROWS_PER_BUCKET)
    buckets = max(2, buckets)
    ranked = df.withColumn("_order", F.col(order).cast("double"))
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = ranked.approxQuantile("_order", probabilities, 1 / (4 * buckets)) or [0.0]
    splits = sorted({float("-inf"), *cuts, float("inf")})
    if len(splits) == 2:
        splits.insert(1, 0.0)
    placed = Bucketizer(
        splits=splits, inputCol="_order", outputCol="_bucket", handleInvalid="keep"
    ).transform(ranked)
    placed = placed.withColumn("_bucket", F.coalesce("_bucket", F.lit(-1.0)))

    # One row per bucket.
    totals = placed.groupBy("_bucket").agg(F.sum(value).alias("_total"))
    below = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "_bucket", F.coalesce(F.sum("_total").over(below), F.lit(0)).alias("_shift")
    )

    inside = (
        Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(shifts, "_bucket")
        .withColumn(out, F.col("_inside") + F.col("_shift"))
        .select(*df.columns, out)
    )


def dense_index(ids: DataFrame, column: str, out: str = "idx") -> DataFrame:
    """Distinct ids numbered 0, 1, 2, ... in ascending order."""
    distinct = ids.select(column).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(distinct, column, "_one", out).select(column, out)
