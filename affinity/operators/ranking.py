"""The ranker: training samples, logistic regression, and scoring from a model table."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions.vectors import merge_features
from affinity.operators.candidates import WIDE_PER_TASK, article_side
from affinity.plans.skew import split_join
from affinity.sources import schemas

INTERCEPT = "(intercept)"

# Vector slots per partition of the training set, 64 MB as doubles.
VALUES_PER_PARTITION = 8_000_000


def nonempty(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is present and has slots."""
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0))


def training_samples(
    samples: DataFrame,
    user_vectors: DataFrame,
    article_vectors: DataFrame,
    embeddings: DataFrame,
    most_per_task: int = WIDE_PER_TASK,
) -> DataFrame:
    """Labelled samples with all three vectors; samples missing one drop out.

    Pass saved or staged samples: their hot users and articles are counted.
    """
    users = nonempty(user_vectors, "features").select(
        "uid", F.col("features").alias("user_features")
    )
    articles = article_side(
        nonempty(article_vectors, "features"), nonempty(embeddings, "article_vector")
    ).select(
        F.col("article_id").alias("aid"),
        F.col("features").alias("article_features"),
        F.col("article_vector").alias("article_embedding"),
    )
    with_user = split_join(samples, users, "uid", "aid", most_per_task, unique_right=True)
    joined = split_join(
        with_user, articles, "aid", "uid", most_per_task, sized_by=samples, unique_right=True
    )
    return joined.select(
        "uid", "aid", "user_features", "article_features", "article_embedding",
        F.col("label").cast("int").alias("label"),
    )


def merged_features(samples: DataFrame) -> DataFrame:
    """Samples with one ``features`` array: article, embedding, user."""
    order = ("article_features", "article_embedding", "user_features")
    return samples.withColumn("features", merge_features(*[F.col(name) for name in order]))


def _even(samples: DataFrame, features: str) -> DataFrame:
    """Samples in as many partitions as their vectors fill, and no fewer than there are cores,
    since each step runs over all of them."""
    first = samples.select(F.size(features)).first()
    if first is None:
        return samples
    cores = samples.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, math.ceil(samples.count() * max(1, first[0]) / VALUES_PER_PARTITION))
    if wanted > samples.rdd.getNumPartitions():
        return samples.repartition(wanted)
    return samples.coalesce(wanted)


def fit_ranker(
    samples: DataFrame, features: str = "features", label: str = "label",
    max_iter: int = 100, reg: float = 0.0, tol: float = 1e-6,
) -> LogisticRegressionModel:
    """Logistic regression with intercept on standardised features.

    Pass staged samples; the solver keeps them as blocks in memory and makes one
    pass per step.
    """
    vectors = _even(samples, features).select(
        array_to_vector(features).alias("vector"), F.col(label).cast("double").alias("label")
    )
    return LogisticRegression(
        featuresCol="vector", labelCol="label", fitIntercept=True, standardization=True,
        maxIter=max_iter, regParam=reg, tol=tol,
    ).fit(vectors)


def predict(model: LogisticRegressionModel, samples: DataFrame, features: str) -> DataFrame:
    """Samples with the probability ``p1`` and class ``prediction`` of a fitted model."""
    scored = model.transform(samples.withColumn("vector", array_to_vector(features)))
    return scored.withColumn("p1", vector_to_array("probability")[1]).drop(
        "vector", "rawPrediction", "probability"
    )


def loss_history(spark: SparkSession, model: LogisticRegressionModel) -> DataFrame:
    """(iteration, loss) of the training run."""
    rows = [(i, float(x)) for i, x in enumerate(model.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "iteration int, loss double")


def training_metrics(spark: SparkSession, model: LogisticRegressionModel) -> DataFrame:
    """(metric, value): training accuracy and area under ROC as the library reports them."""
    summary = model.summary
    rows = [("accuracy", float(summary.accuracy)), ("auc", float(summary.areaUnderROC))]
    return spark.createDataFrame(rows, "metric string, value double")


def model_table(
    spark: SparkSession, model: LogisticRegressionModel, prefix: str = "f"
) -> DataFrame:
    """Coefficients as (feature, value, coefficient) rows, with an intercept row."""
    rows = [(INTERCEPT, None, float(model.intercept))]
    rows += [
        (f"{prefix}{i + 1}", None, float(c)) for i, c in enumerate(model.coefficients.toArray())
    ]
    return spark.createDataFrame(rows, schemas.MODEL)


def _slot_weights(numeric: DataFrame) -> DataFrame:
    """One row with the weights of slots 1 to the largest one a term names; others weigh 0."""
    number = F.regexp_extract("feature", r"^f([1-9][0-9]*)$", 1).try_cast("int")
    unknown = F.raise_error(F.concat(F.lit("no slot named "), "feature")).cast("int")
    by_slot = numeric.groupBy(F.coalesce(number, unknown).alias("slot")).agg(
        F.sum("coefficient").alias("weight")
    )
    slots = by_slot.agg(F.max("slot").alias("last")).select(
        F.explode(F.sequence(F.lit(1), F.coalesce("last", F.lit(1)))).alias("slot")
    )
    entry = F.struct("slot", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    ordered = slots.join(by_slot, "slot", "left").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return ordered.select(F.transform("x", lambda e: e["weight"]))


def _vector_sum(vector: str, weights: str) -> Column:
    """The dot product of two columns; widths must agree."""
    wrong = F.raise_error(F.lit(f"{vector} is not as wide as the model")).cast("double")
    products = F.zip_with(vector, weights, lambda x, w: x * w)
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(vector) == F.size(weights), total).otherwise(wrong)


def linear_score(rows: DataFrame, model: DataFrame, vector: str | None = None) -> DataFrame:
    """Rows with ``z``, ``p1``, ``p0`` and ``prediction`` of a model table.

    A term without value multiplies the column of that name, or with ``vector``
    the slot f1, f2, ... of that array: slots without a term weigh 0, and a
    vector that ends before or after the largest slot is an error, as is a term
    that names no slot or column. A term with value adds its coefficient where
    the column holds the value. Repeated terms add up. Numeric terms are part of
    the expression; a column with categorical terms is looked up by a left join
    with them.
    """
    columns = rows.columns
    named = F.col("feature").isin(columns)
    plain = F.col("value").isNull()
    intercept = F.col("feature") == INTERCEPT
    other = ~intercept & ~named & (F.lit(vector is None) | ~plain)
    sums = [F.sum(F.when(plain & (F.col("feature") == c), F.col("coefficient"))) for c in columns]
    kinds = [F.bool_or(~plain & (F.col("feature") == c)) for c in columns]
    start = F.sum(F.when(plain & intercept, F.col("coefficient")))
    # One row, as wide as the table that is scored.
    facts = model.agg(start, F.count_if(other), *sums, *kinds).first()
    if facts[1]:
        raise ValueError(f"{facts[1]} model terms name no column")
    weights, categorical = facts[2 : 2 + len(columns)], facts[2 + len(columns) :]

    z = F.lit(facts[0] or 0.0)
    if vector is not None:
        slots = _slot_weights(model.where(plain & ~intercept))
        rows = rows.withColumn("_weights", slots.scalar())
        z = z + _vector_sum(vector, "_weights")
    else:
        for name, weight in zip(columns, weights):
            if weight is not None:
                z = z + F.col(name).cast("double") * F.lit(weight)
    for i, name in enumerate(name for name, has in zip(columns, categorical) if has):
        terms = model.where(~plain & (F.col("feature") == name)).groupBy("value").agg(
            F.sum("coefficient").alias(f"_weight{i}")
        )
        terms = terms.withColumnRenamed("value", f"_value{i}")
        rows = rows.join(terms, F.col(name).cast("string") == F.col(f"_value{i}"), "left")
        z = z + F.coalesce(f"_weight{i}", F.lit(0.0))

    scored = rows.select(*columns, z.alias("z"))
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
    return (
        scored.withColumn("p1", p1)
        .withColumn("p0", F.lit(1.0) - F.col("p1"))
        .withColumn("prediction", (F.col("p1") > 0.5).cast("int"))
    )
