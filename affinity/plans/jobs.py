"""The batch jobs, end to end: input tables in, saved tables and cells out.

Each job takes DataFrames with the schemas of ``affinity.sources.schemas`` and a
:class:`Sink`, writes what the serving side needs, and returns its tables and
metrics. Jobs meet through tables only: recall and features first, then
:func:`union_features` and :func:`train_ranker`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from affinity.functions.rating import ACTION_WEIGHTS
from affinity.functions.vectors import parse_vector
from affinity.operators import (
    als,
    candidates,
    embedding,
    evaluate,
    export,
    features,
    itemcf,
    publish,
    ranking,
    ratings,
    similarity,
)
from affinity.plans.staging import scratch, stage
from affinity.sources import tables


class Sink(NamedTuple):
    """Where a job writes: the catalog database of its tables and the folder of its cells.

    With ``table_path`` the table files live there instead of in the warehouse. A table is
    published in versions, of which the newest ``keep`` stay.
    """

    cells_path: str
    database: str | None = None
    table_path: str | None = None
    keep: int = 2

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Publish a table; later steps read the saved copy."""
        catalog = df.sparkSession.catalog
        database = self.database or catalog.currentDatabase()
        folder = self.table_path or catalog.getDatabase(database).locationUri
        root = f"{folder}/{name}" if self.table_path else f"{folder}/{name}.versions"
        return publish.publish_table(df, f"{database}.{name}", root, keep=self.keep)

    def cells(self, rows: DataFrame, name: str) -> None:
        """Write cells in key order."""
        export.write_cells(rows, f"{self.cells_path}/{name}")


def rate(
    actions: DataFrame, as_of: dt.date, weights: Mapping[str, float] = ACTION_WEIGHTS
) -> DataFrame:
    """Staged ratings of a behaviour log."""
    scanned = tables.scan_user_actions(actions)
    return stage(ratings.user_item_ratings(scanned, as_of, weights), "ratings")


def _kept(metric: DataFrame) -> DataFrame:
    """A one-row metric, computed now, so that it reads nothing staged later."""
    return metric.sparkSession.createDataFrame(metric.collect(), metric.schema)


def run_itemcf(
    actions: DataFrame,
    as_of: dt.date,
    sink: Sink,
    k: int = itemcf.JOB_TOP_K,
    weights: Mapping[str, float] = ACTION_WEIGHTS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Item-based recall: the ``itemcf`` table, its cells, and the hold-out error."""
    with scratch(actions.sparkSession):
        rated = rate(actions, as_of, weights)
        training, holdout = ratings.random_split(rated, 0.8, seed)
        near = similarity.staged_similarity(training)
        predicted = itemcf.predict_holdout(training, holdout, similarity.symmetric(near))
        rmse = _kept(evaluate.rmse(predicted))
        best = itemcf.best_unseen_blocked(training, k, similarity=near).drop("rank")
        saved = sink.table(best, "itemcf")
        lists = candidates.recommendation_lists(saved, "sim_aid")
        sink.cells(export.itemcf_cells(lists), "itemcf")
        return saved, rmse


def run_als(
    actions: DataFrame,
    as_of: dt.date,
    sink: Sink,
    k: int = itemcf.JOB_TOP_K,
    weights: Mapping[str, float] = ACTION_WEIGHTS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Factor-based recall: the ``als`` table, its cells, and the hold-out error."""
    with scratch(actions.sparkSession):
        rated = rate(actions, as_of, weights)
        training, holdout = ratings.random_split(rated, 0.5, seed)
        recall = als.fit_als(training, seed=seed)
        rmse = _kept(evaluate.rmse(als.predict(recall, holdout), prediction="prediction"))
        saved = sink.table(als.unseen(als.topk_all(recall, k), rated), "als")
        lists = candidates.recommendation_lists(saved, "pred_aid")
        sink.cells(export.als_cells(lists), "als")
        return saved, rmse


def run_user_features(profiles: DataFrame, sink: Sink) -> DataFrame:
    """The ``user_base_vector`` table and its cells."""
    with scratch(profiles.sparkSession):
        vectors = features.user_features(tables.scan_user_base(profiles))
        saved = sink.table(vectors, "user_base_vector")
        sink.cells(export.user_base_cells(saved), "user_base")
        return saved


def run_article_features(facts: DataFrame, sink: Sink) -> DataFrame:
    """The ``article_base_vector`` table and its cells."""
    with scratch(facts.sparkSession):
        vectors = features.article_features(tables.scan_article_base(facts))
        saved = sink.table(vectors, "article_base_vector")
        sink.cells(export.article_base_cells(saved), "article_base")
        return saved


def run_embedding(terms: DataFrame, sink: Sink) -> DataFrame:
    """The ``article_embedding`` table and its cells."""
    means = embedding.article_embedding(tables.scan_article_terms(terms))
    saved = sink.table(means, "article_embedding")
    sink.cells(export.embedding_cells(saved), "embedding")
    return saved


def union_features(
    itemcf_table: DataFrame,
    als_table: DataFrame,
    user_vectors: DataFrame,
    article_vectors: DataFrame,
    embeddings: DataFrame,
    sink: Sink,
) -> None:
    """Cells of users with candidates, and of both candidate sets with their features."""
    with scratch(itemcf_table.sparkSession):
        users = candidates.recommended_user_features(als_table, itemcf_table, user_vectors)
        sink.cells(export.user_feature_cells(users), "user_features")
        for table, item, name in (
            (itemcf_table, "sim_aid", "itemcf"), (als_table, "pred_aid", "als"),
        ):
            wide = candidates.candidate_features(table, article_vectors, embeddings, item)
            lists = candidates.candidate_lists(wide, item)
            sink.cells(export.candidate_cells(lists, name), f"{name}_features")


class Ranker(NamedTuple):
    """The saved model table, and what its training reported."""

    model: DataFrame
    loss: DataFrame
    metrics: DataFrame


def _ranker(spark: SparkSession, samples: DataFrame, sink: Sink, name: str) -> Ranker:
    fitted = ranking.fit_ranker(stage(samples, "samples"))
    return Ranker(
        sink.table(ranking.model_table(spark, fitted), name),
        ranking.loss_history(spark, fitted),
        ranking.training_metrics(spark, fitted),
    )


def train_ranker(
    labels: DataFrame,
    user_vectors: DataFrame,
    article_vectors: DataFrame,
    embeddings: DataFrame,
    sink: Sink,
) -> Ranker:
    """The ``lr_model`` table, fitted on labels joined to all three vectors."""
    with scratch(labels.sparkSession):
        samples = ranking.training_samples(
            tables.scan_training(labels), user_vectors, article_vectors, embeddings
        )
        merged = ranking.merged_features(samples).select("features", "label")
        return _ranker(labels.sparkSession, merged, sink, "lr_model")


def train_csv_ranker(spark: SparkSession, path: str, sink: Sink) -> Ranker:
    """The ``lr_csv_model`` table, fitted on text vectors of a labelled CSV."""
    with scratch(spark):
        rows = tables.binary_labels(tables.scan_labelled_csv(spark, path))
        parsed = rows.withColumn("features", parse_vector(rows["features"]))
        return _ranker(spark, parsed, sink, "lr_csv_model")
