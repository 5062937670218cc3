"""Feature vectors of users and articles.

A category is indexed by a table of its values, however many there are; a vector is put
together from (size, indices, values) and made dense at the end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.functions.vectors import dense
from affinity.plans.skew import tasks_for
from affinity.plans.staging import stage

# Lower bounds of the age groups; the last one is open.
AGE_SPLITS = [0.0, 15.0, 25.0, 35.0, 50.0, 60.0, float("inf")]
USER_CATEGORIES = ("gender", "email_suffix")
ARTICLE_NUMBERS = ("article_num", "img_num", "pub_gap")
VALUES_PER_TASK = 1_000_000

Bounds = dict[str, tuple[float, float]]


def category_index(rows: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """(column, index) of every value: by falling frequency, ties alphabetical.

    Values are counted, sorted in ranges, numbered within each and shifted by the
    ranges before, so no task sees them all. A missing value is an error.
    """
    missing = F.raise_error(F.lit(f"{column} is missing")).cast("string")
    value = F.coalesce(F.col(column).cast("string"), missing).alias(column)
    counts = stage(rows.groupBy(value).agg(F.count("*").alias("n")), "values")
    if partitions is None:
        partitions = tasks_for(rows.sparkSession, counts.count(), VALUES_PER_TASK)
    ranged = counts.repartitionByRange(partitions, F.desc("n"), F.asc(column))
    placed = stage(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("range").agg(F.count("*").alias("size"))
    shifts = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("range").orderBy(F.desc("n"), F.asc(column))
    index = (F.row_number().over(inside) - 1 + F.col("shift")).cast("double")
    return placed.join(shifts, "range").select(column, index.alias(f"{column}_index"))


def indexed(rows: DataFrame, indexes: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with ``<column>_index`` for each of the indexes; unknown values drop out."""
    for column, index in indexes.items():
        rows = rows.join(index, column)
    return rows


def one_hot(index: str, width: int) -> Column:
    """(size, indices, values) with a 1 at the index, and no slot for the last, rarest value."""
    hot = F.col(index) < width - 1
    return F.struct(
        F.lit(width - 1).alias("size"),
        F.when(hot, F.array(F.col(index).cast("int"))).otherwise(F.array().cast("array<int>")).alias("indices"),
        F.when(hot, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"),
    )


def to_dense(vector: Column) -> Column:
    """A sparse vector as ``array<double>``."""
    return dense(vector["size"], vector["indices"], vector["values"])


def _width(index: DataFrame, column: str) -> int:
    n = index.count()
    if n < 2:
        raise ValueError(f"{column!r} needs at least two distinct values, has {n}")
    return n


def age_bucketizer() -> Bucketizer:
    """Age to the number of its age group; a negative or missing age is an error."""
    return Bucketizer(inputCol="age", outputCol="age_group", splits=AGE_SPLITS)


def column_bounds(rows: DataFrame, *columns: str) -> Bounds:
    """Smallest and largest value of each column, in one pass."""
    ends = [end(F.col(c).cast("double")) for c in columns for end in (F.min, F.max)]
    row = rows.agg(*ends).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def minmax(column: str, bounds: Bounds) -> Column:
    """A number scaled to [0, 1]; a constant column becomes 0.5, a missing number is an error."""
    low, high = bounds[column]
    if low is None or low == high:
        return F.lit(0.5)
    number = F.coalesce(F.col(column).cast("double"), F.raise_error(F.lit(f"{column} is missing")))
    return (number - F.lit(low)) / F.lit(high - low)


class FeatureModel(NamedTuple):
    """Category indexes with their numbers of values, and column bounds."""

    indexes: dict[str, DataFrame]
    widths: dict[str, int]
    bounds: Bounds


def _fit(rows: DataFrame, categories: tuple[str, ...], bounds: Bounds) -> FeatureModel:
    indexes = {column: stage(category_index(rows, column), "index") for column in categories}
    return FeatureModel(indexes, {c: _width(i, c) for c, i in indexes.items()}, bounds)


def fit_user_features(profiles: DataFrame) -> FeatureModel:
    """Indexes of gender and email suffix, and the range of age groups."""
    grouped = age_bucketizer().transform(profiles)
    return _fit(profiles, USER_CATEGORIES, column_bounds(grouped, "age_group"))


def apply_user_features(model: FeatureModel, profiles: DataFrame) -> DataFrame:
    """(uid, features). Slots: gender, email suffix, scaled age group."""
    rows = age_bucketizer().transform(indexed(profiles, model.indexes))
    onehot = [to_dense(one_hot(f"{c}_index", model.widths[c])) for c in USER_CATEGORIES]
    features = F.concat(*onehot, F.array(minmax("age_group", model.bounds)))
    return rows.select("uid", features.alias("features"))


def user_features(profiles: DataFrame) -> DataFrame:
    """(uid, features) fitted on the same profiles."""
    return apply_user_features(fit_user_features(profiles), profiles)


def fit_article_features(facts: DataFrame) -> FeatureModel:
    """Index of the article type, and the ranges of the three numbers."""
    return _fit(facts, ("type_name",), column_bounds(facts, *ARTICLE_NUMBERS))


def apply_article_features(model: FeatureModel, facts: DataFrame) -> DataFrame:
    """(article_id, features). Slots: scaled length, images and age, then the type."""
    numbers = F.array(*[minmax(name, model.bounds) for name in ARTICLE_NUMBERS])
    types = to_dense(one_hot("type_name_index", model.widths["type_name"]))
    rows = indexed(facts, model.indexes)
    return rows.select("article_id", F.concat(numbers, types).alias("features"))


def article_features(facts: DataFrame) -> DataFrame:
    """(article_id, features) fitted on the same facts."""
    return apply_article_features(fit_article_features(facts), facts)
