from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from affinity.operators import candidates, evaluate, ranking
from affinity.queries.ranking import CATEGORICAL_MODEL, NUMERIC_MODEL
from affinity.sources import schemas


def test_numeric_scores(spark):
    rows = spark.createDataFrame(
        [(1, [0.0] * 4), (2, [0.1, -0.2, 0.3, 0.25])], "id int, x array<double>"
    )
    model = spark.createDataFrame(NUMERIC_MODEL, schemas.MODEL)
    got = {r.id: r for r in ranking.linear_score(rows, model, vector="x").collect()}
    assert got[1].p1 == pytest.approx(0.1213660192714052, abs=1e-15)
    assert got[1].prediction == 0 and got[1].p0 + got[1].p1 == pytest.approx(1)
    assert got[2].z == pytest.approx(8.752659351525292, abs=1e-12)
    assert got[2].p1 == pytest.approx(0.9998419844922629, abs=1e-12)
    assert got[2].prediction == 1


def test_categorical_scores(spark):
    values = ["0.2", "1.8", None, "1.7"]
    rows = spark.createDataFrame(
        [(i, 5.0, 3.0, 1.5, v) for i, v in enumerate(values)],
        "id int, sepal_length double, sepal_width double, petal_length double, petal_width string",
    )
    model = spark.createDataFrame(CATEGORICAL_MODEL, schemas.MODEL)
    scored = ranking.linear_score(rows, model)
    assert scored.columns == [*rows.columns, "z", "p1", "p0", "prediction"]
    got = {r.id: r.z for r in scored.collect()}
    base = -18.243543304562436 + 12.42706970289986
    assert got == pytest.approx(
        {0: -18.243543304562436, 1: base, 2: base, 3: base + 1.4198479510919209}
    )


@pytest.mark.parametrize(
    "terms, vector, expected",
    [
        ([("f1", 2.0), ("f3", 3.0)], [1.0, 10.0, 100.0], 302.5),
        ([("f1", 2.0), ("f3", 3.0), ("f7", 1.0)], [1.0, 0.0, 1.0, 9.0, 9.0, 9.0, 5.0], 10.5),
        ([("f2", 2.0), ("f2", 5.0)], [1.0, 3.0], 21.5),
    ],
)
def test_scores_with_gaps_and_repeats(spark, terms, vector, expected):
    model = [(ranking.INTERCEPT, None, 0.5), *((name, None, weight) for name, weight in terms)]
    rows = spark.createDataFrame([(vector,)], "x array<double>")
    scored = ranking.linear_score(rows, spark.createDataFrame(model, schemas.MODEL), vector="x")
    assert scored.first().z == pytest.approx(expected)


@pytest.mark.parametrize("terms", [[("f1", 2.0)], [("f1", 1.0), ("f9", 1.0)], [("g1", 1.0), ("f2", 1.0)]])
def test_wrong_width_or_slot_is_an_error(spark, terms):
    model = spark.createDataFrame([(n, None, w) for n, w in terms], schemas.MODEL)
    rows = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    with pytest.raises(Exception, match="as wide as|no slot"):
        ranking.linear_score(rows, model, vector="x").collect()


def test_repeated_categorical_terms_add_up(spark):
    model = [("a", "x", 1.0), ("a", "x", 2.0), ("b", None, 1.0), ("b", None, 1.5)]
    rows = spark.createDataFrame([("x", 2.0), ("y", 2.0)], "a string, b double")
    scored = ranking.linear_score(rows, spark.createDataFrame(model, schemas.MODEL))
    assert sorted((r.a, r.z) for r in scored.collect()) == [("x", 8.0), ("y", 5.0)]
    with pytest.raises(ValueError):
        ranking.linear_score(rows.drop("b"), spark.createDataFrame(model, schemas.MODEL))


def fitted(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        x = [rng.gauss(0, 1) for _ in range(3)]
        p = 1 / (1 + math.exp(-(0.5 + x[0] - 2 * x[1])))
        rows.append((x, int(rng.random() < p)))
    samples = spark.createDataFrame(rows, "features array<double>, label int")
    return samples, ranking.fit_ranker(samples)


def test_ranker_table_scores_like_the_model(spark):
    samples, model = fitted(spark)
    loss = [r.loss for r in ranking.loss_history(spark, model).orderBy("iteration").collect()]
    assert len(loss) > 2 and all(b <= a + 1e-12 for a, b in zip(loss, loss[1:]))

    table = ranking.model_table(spark, model)
    assert [r.feature for r in table.collect()] == [ranking.INTERCEPT, "f1", "f2", "f3"]
    by_table = ranking.linear_score(samples, table, vector="features")
    by_model = ranking.predict(model, samples, "features")
    a = sorted((r.features[0], r.p1, r.prediction) for r in by_table.collect())
    b = sorted((r.features[0], r.p1, r.prediction) for r in by_model.collect())
    assert [x[0] for x in a] == [x[0] for x in b]
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b])
    assert [x[2] for x in a] == [x[2] for x in b]

    metrics = {r.metric: r.value for r in ranking.training_metrics(spark, model).collect()}
    assert evaluate.accuracy(by_model).first().accuracy == pytest.approx(metrics["accuracy"])
    assert evaluate.auc(by_model).first().auc == pytest.approx(metrics["auc"], abs=1e-9)


def test_training_samples_need_all_three_vectors(spark):
    samples = spark.createDataFrame(
        [(1, 10, 1), (2, 10, 0), (1, 11, 0), (1, 12, 1), (3, 10, 0)], schemas.TRAINING
    )
    users = spark.createDataFrame([(1, [1.0]), (2, []), (3, None)], schemas.USER_VECTOR)
    articles = spark.createDataFrame(
        [(10, [2.0, 3.0]), (11, []), (12, [1.0, 1.0])], schemas.ARTICLE_VECTOR
    )
    embeddings = spark.createDataFrame([(10, [4.0]), (11, [5.0])], schemas.EMBEDDING)
    joined = ranking.training_samples(samples, users, articles, embeddings)
    merged = ranking.merged_features(joined)
    assert merged.select("uid", "aid", "label", "features").collect() == [
        (1, 10, 1, [2.0, 3.0, 4.0, 1.0])
    ]


@pytest.mark.parametrize("most_per_task", [200_000, 4])
def test_training_samples_with_a_hot_article(spark, most_per_task):
    rows = [(u, 10, u % 2) for u in range(40)] + [(0, a, 1) for a in range(11, 30)]
    samples = spark.createDataFrame(rows, schemas.TRAINING)
    users = spark.range(40).select(
        F.col("id").alias("uid"), F.array(F.col("id").cast("double")).alias("features")
    )
    articles = spark.range(10, 30).select(
        F.col("id").alias("article_id"), F.array(F.col("id").cast("double")).alias("features")
    )
    embeddings = articles.withColumnRenamed("features", "article_vector")
    got = ranking.training_samples(samples, users, articles, embeddings, most_per_task)
    assert sorted(
        (r.uid, r.aid, r.user_features, r.article_features, r.label) for r in got.collect()
    ) == sorted((u, a, [float(u)], [float(a)], label) for u, a, label in rows)


def test_candidates_keep_those_with_both_vectors(spark):
    recs = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.7), (2, 10, 0.1)], schemas.ITEMCF)
    vectors = spark.createDataFrame([(10, [1.0]), (11, [2.0])], schemas.ARTICLE_VECTOR)
    embeddings = spark.createDataFrame([(10, [3.0])], schemas.EMBEDDING)
    for parts in (200_000, 1):
        got = candidates.candidate_features(recs, vectors, embeddings, "sim_aid", parts)
        assert sorted(map(tuple, got.collect())) == [
            (1, 10, 0.5, [1.0], [3.0]), (2, 10, 0.1, [1.0], [3.0]),
        ]
    als = spark.createDataFrame([(2, 9, 0.1), (3, 9, 0.1)], schemas.ALS)
    users = spark.createDataFrame([(1, [1.0]), (3, [3.0]), (4, [4.0])], schemas.USER_VECTOR)
    assert sorted(r.uid for r in candidates.recommended_users(als, recs).collect()) == [1, 2, 3]
    kept = candidates.recommended_user_features(als, recs, users).collect()
    assert sorted(map(tuple, kept)) == [(1, [1.0]), (3, [3.0])]


@pytest.mark.parametrize("levels", [3, 1000])
def test_auc_with_and_without_ties(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.randrange(levels) / levels, rng.randrange(2)) for _ in range(200)]
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    df = spark.createDataFrame(rows, "p1 double, label int")
    got = evaluate.auc(df).first().auc
    assert got == pytest.approx(wins / len(pos) / len(neg))
    library = BinaryClassificationEvaluator(rawPredictionCol="p1", numBins=0)
    assert got == pytest.approx(library.evaluate(df))


@pytest.mark.parametrize("row", [(None, 1), (0.5, None)])
def test_auc_of_a_missing_score_or_label_is_an_error(spark, row):
    df = spark.createDataFrame([(0.5, 1), (0.6, 0), row], "p1 double, label int")
    with pytest.raises(Exception, match="missing"):
        evaluate.auc(df).collect()


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.5, 1), (0.6, 1)], "p1 double, label int")
    assert evaluate.auc(df).first().auc is None


def test_rmse(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0)], "rating double, pred_rating double")
    assert evaluate.rmse(df).first().rmse == pytest.approx(math.sqrt(2.5))


@pytest.mark.parametrize("values, parts", [(8_000_000, 8), (300, 8), (10, 90)])
def test_training_partitions_follow_the_vectors(spark, monkeypatch, values, parts):
    monkeypatch.setattr(ranking, "VALUES_PER_PARTITION", values)
    samples, _ = fitted(spark)
    assert ranking._even(samples, "features").rdd.getNumPartitions() == parts
    assert ranking._even(samples, "features").count() == 300
    assert ranking._even(samples.limit(0), "features").count() == 0
