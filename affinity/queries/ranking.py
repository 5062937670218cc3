"""Registered queries: candidates with features, training samples, scoring and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions import vectors as fn
from affinity.operators import candidates, evaluate, itemcf, ranking
from affinity.plans.staging import stage
from affinity.queries import inputs
from affinity.queries.features import filter_binary_label
from affinity.queries.inputs import DIGITS, rounded
from affinity.queries.sql import millionths, using
from affinity.sources import schemas, standins

# A model with a term for each of the 64 embedding slots, from a rule.
SLOT_MODEL = [
    (ranking.INTERCEPT, None, 0.25),
    *((f"f{i}", None, (i * 37 % 41 - 20) / 10) for i in range(1, 65)),
]

# A model with four numeric terms.
NUMERIC_MODEL = [
    (ranking.INTERCEPT, None, -1.979557474498824),
    ("f1", None, -0.805920436998945),
    ("f2", None, -12.098913883790336),
    ("f3", None, 9.068073983322742),
    ("f4", None, 22.69041559187648),
]

# A model with three numeric terms and one categorical column.
CATEGORICAL_MODEL = [
    (ranking.INTERCEPT, None, -0.35652298506335317),
    ("sepal_length", None, 4.386704917040299),
    ("sepal_width", None, -12.176411968674852),
    ("petal_length", None, 6.090507136149227),
    ("petal_width", "0.2", -12.42706970289986),
    ("petal_width", "1.3", 6.766477995725868),
    ("petal_width", "1.5", 5.290176573100581),
    ("petal_width", "0.4", -10.102689909480713),
    ("petal_width", "1.4", 4.894191581791746),
    ("petal_width", "0.3", -15.190023604356995),
    ("petal_width", "1.0", 6.256136500828763),
    ("petal_width", "0.1", -10.883425552828072),
    ("petal_width", "1.2", 5.506660035160129),
    ("petal_width", "1.1", 9.043994343446183),
    ("petal_width", "1.6", 8.61825902106249),
    ("petal_width", "0.5", -10.779700242777585),
    ("petal_width", "1.7", 1.4198479510919209),
    ("petal_width", "0.6", -9.314510119148924),
]


# How near the solver comes to the least loss, as a mean per slot.
MOMENT_TOLERANCE = 1e-4


def shown(df: DataFrame, *vectors: str) -> DataFrame:
    """Array columns as text of whole millionths, which two engines write alike."""
    return df.withColumns(
        {
            name: F.concat_ws(
                ",", F.transform(name, lambda x: F.round(x * 1e6).cast("bigint").cast("string"))
            )
            for name in vectors
        }
    )


def with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-based candidates with article vector and embedding."""
    return candidates.candidate_features(
        stage(inputs.topk(spark, sf_dir).drop("rank"), "itemcf"),
        inputs.article_vectors(spark, sf_dir),
        inputs.embeddings(spark, sf_dir),
        "sim_aid",
    )


def candidate_features_itemcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rounded(with_features(spark, sf_dir), "pred_rating")
    return shown(wide, "features", "article_vector")


def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested lists, shown as one row per list position."""
    lists = candidates.candidate_lists(
        rounded(with_features(spark, sf_dir), "pred_rating"), "sim_aid"
    )
    flat = lists.select("uid", F.posexplode("recommendations").alias("pos", "r"))
    return shown(flat.select("uid", "pos", "r.*"), "features", "article_vector")


def recall_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two recall tables: hold-out predictions, and top-k recommendations."""
    train, holdout = inputs.split(spark, sf_dir)
    near = itemcf.neighbours(train)
    best = itemcf.best_unseen(train, inputs.K, F.round("pred_rating", DIGITS), near)
    return itemcf.predict_holdout(train, holdout, near), best


def recommended_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.recommended_users(*recall_tables(spark, sf_dir))


def user_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of users in either recall table."""
    return candidates.recommended_user_features(
        *recall_tables(spark, sf_dir), inputs.user_vectors(spark, sf_dir)
    )


def recommended_user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(user_side(spark, sf_dir), "user_features")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples with all three vectors."""
    return ranking.training_samples(
        stage(standins.training(spark, sf_dir), "labels"),
        stage(inputs.user_vectors(spark, sf_dir), "user-vectors"),
        stage(inputs.article_vectors(spark, sf_dir), "article-vectors"),
        stage(inputs.embeddings(spark, sf_dir), "embeddings"),
    )


def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ranking.merged_features(samples(spark, sf_dir))
    return shown(merged.select("uid", "aid", "label", "features"), "features")


def _fitted(spark: SparkSession, sf_dir: str):
    merged = ranking.merged_features(samples(spark, sf_dir)).select("features", "label")
    return ranking.fit_ranker(stage(merged, "samples"))


def lr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per iteration, then training accuracy and area under ROC."""
    model = _fitted(spark, sf_dir)
    loss = ranking.loss_history(spark, model)
    return loss.select(
        F.format_string("loss_%03d", "iteration").alias("metric"), F.col("loss").alias("value")
    ).unionByName(ranking.training_metrics(spark, model))


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.model_table(spark, _fitted(spark, sf_dir))


def lr_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranker fitted on text vectors from a labelled CSV, as a model table."""
    parsed = filter_binary_label(spark, sf_dir).withColumn(
        "features", fn.parse_vector(F.col("features"))
    )
    return ranking.model_table(spark, ranking.fit_ranker(stage(parsed, "csv")))


def _moments(samples: DataFrame) -> DataFrame:
    """Per slot (0: the intercept) the mean of label times value, and whether the fitted model's
    probabilities have the same mean, as they must where the unregularised loss is least."""
    model = ranking.fit_ranker(samples, max_iter=500, tol=1e-12)
    slots = ranking.predict(model, samples, "features").select(
        "label", "p1", F.posexplode(F.concat(F.array(F.lit(1.0)), "features")).alias("slot", "x")
    )
    means = slots.groupBy("slot").agg(
        F.avg(F.col("label") * F.col("x")).alias("label_mean"), F.avg(F.col("p1") * F.col("x")).alias("model_mean")
    )
    same = F.abs(F.col("label_mean") - F.col("model_mean")) < MOMENT_TOLERANCE
    return rounded(means.select("slot", "label_mean", same.alias("same")), "label_mean")


def lr_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ranking.merged_features(samples(spark, sf_dir)).select("features", "label")
    return _moments(stage(merged, "samples"))


def lr_csv_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = filter_binary_label(spark, sf_dir).withColumn("features", fn.parse_vector(F.col("features")))
    return _moments(stage(parsed, "csv"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings scored on all their slots."""
    rows = standins.read(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("label") % 2).alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    model = spark.createDataFrame(SLOT_MODEL, schemas.MODEL)
    return ranking.linear_score(rows, model, vector="x").drop("x")


def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir), "z", "p1", "p0")


def linear_score_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three numbers from the mean of a third of the slots each, and a text column."""

    def mean(first: int, n: int) -> Column:
        part = F.slice("embedding", first, n).cast("array<double>")
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / n

    rows = standins.read(spark, sf_dir, "embeddings").select(
        "vec_id",
        (mean(1, 21) + 5).alias("sepal_length"),
        (mean(22, 21) + 3).alias("sepal_width"),
        (mean(43, 22) + 1.5).alias("petal_length"),
        F.format_string("%.1f", (F.col("vec_id") % 20) / 10).alias("petal_width"),
    )
    model = spark.createDataFrame(CATEGORICAL_MODEL, schemas.MODEL)
    result = ranking.linear_score(rows, model)
    return rounded(
        result.select("vec_id", "petal_width", "z", "p1", "p0", "prediction"), "z", "p1", "p0"
    )


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.accuracy(scored(spark, sf_dir)), "accuracy")


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.auc(scored(spark, sf_dir)), "auc")


def auc_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under ROC of a coarse score: order quantity against returned lines."""
    lines = standins.read(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("p1"), (F.col("l_returnflag") == "R").cast("int").alias("label")
    )
    return rounded(evaluate.auc(lines), "auc")


QUERIES = {
    f.__name__: f
    for f in (
        candidate_features_itemcf, candidate_lists, recommended_users, recommended_user_features,
        training_samples, lr_fit, lr_moments, lr_csv_moments, model_table, lr_csv, linear_score, linear_score_categorical,
        accuracy, auc, auc_tied,
    )
}

_EITHER = "SELECT uid FROM predicted UNION SELECT uid FROM topk"


def _auc_sql(rows: str, score: str, positive: str) -> str:
    """Rank-sum form with average ranks for ties."""
    return f"""SELECT round((sum(CASE WHEN pos THEN rank END) - sum(pos::INT)::DOUBLE
            * (sum(pos::INT) + 1) / 2) / (sum(pos::INT)::DOUBLE * sum((NOT pos)::INT)), 6) AS auc
        FROM (SELECT {positive} AS pos, rank() OVER (ORDER BY {score})
                     + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS rank
              FROM {rows})"""


def _moments_sql(rows: str) -> str:
    """Mean of label times value for every slot of ``rows`` (label, x)."""
    return f"""SELECT CAST(slot - 1 AS INTEGER) AS slot, round(avg(label * v), 6) + 0.0 AS label_mean, TRUE AS same
        FROM (SELECT label, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS slot FROM ({rows}))
        GROUP BY slot"""


_WEIGHTS = " ".join(f"WHEN '{v}' THEN {c!r}::DOUBLE" for _, v, c in CATEGORICAL_MODEL[4:])
_B, _SL, _SW, _PL = (f"{c!r}::DOUBLE" for _, _, c in CATEGORICAL_MODEL[:4])

ORACLES = {
    "candidate_features_itemcf": using(
        "candidates",
        select=f"""SELECT uid, sim_aid, round(pred_rating, 6) AS pred_rating,
                          {millionths("features")} AS features, {millionths("article_vector")} AS article_vector
                   FROM candidates""",
    ),
    "candidate_lists": using(
        "candidates",
        select=f"""SELECT uid, CAST(row_number() OVER (PARTITION BY uid
                            ORDER BY round(pred_rating, 6) DESC, sim_aid) - 1 AS INTEGER) AS pos,
                          sim_aid AS aid, round(pred_rating, 6) AS rating,
                          {millionths("features")} AS features, {millionths("article_vector")} AS article_vector
                   FROM candidates""",
    ),
    "recommended_users": using("predicted", "topk", select=_EITHER),
    "recommended_user_features": using(
        "predicted", "topk", "user_vectors",
        select=f"""SELECT r.uid, {millionths("u.features")} AS user_features
                   FROM ({_EITHER}) r JOIN user_vectors u ON r.uid = u.uid""",
    ),
    "training_samples": using(
        "assembled",
        select=f"""SELECT uid, aid, label, {millionths('''list_concat(list_concat(article_features,
                          article_embedding), user_features)''')} AS features FROM assembled""",
    ),
    "lr_moments": using(
        "assembled",
        select=_moments_sql(
            """SELECT label, list_concat([1.0::DOUBLE], list_concat(list_concat(article_features,
               article_embedding), user_features)) AS x FROM assembled"""
        ),
    ),
    "lr_csv_moments": _moments_sql(
        """SELECT label % 3 AS label, list_concat([1.0::DOUBLE],
           [round(e::DOUBLE, 6) FOR e IN embedding]) AS x FROM embeddings WHERE label % 3 < 2"""
    ),
    "linear_score": using(
        "scored",
        select="""SELECT vec_id, label, round(z, 6) AS z, round(p1, 6) AS p1,
                         round(1 - p1, 6) AS p0, prediction FROM scored""",
    ),
    "linear_score_categorical": f"""SELECT vec_id, petal_width, round(z, 6) AS z,
        round(1 / (1 + exp(-z)), 6) AS p1, round(1 - 1 / (1 + exp(-z)), 6) AS p0,
        CASE WHEN 1 / (1 + exp(-z)) > 0.5 THEN 1 ELSE 0 END AS prediction
        FROM (SELECT vec_id, petal_width, {_B} + {_SL} * a + {_SW} * b + {_PL} * c
                     + CASE petal_width {_WEIGHTS} ELSE 0 END AS z
              FROM (SELECT vec_id, list_sum(list_slice(embedding, 1, 21)::DOUBLE[]) / 21 + 5 AS a,
                           list_sum(list_slice(embedding, 22, 42)::DOUBLE[]) / 21 + 3 AS b,
                           list_sum(list_slice(embedding, 43, 64)::DOUBLE[]) / 22 + 1.5 AS c,
                           printf('%.1f', (vec_id % 20)::DOUBLE / 10) AS petal_width
                    FROM embeddings))""",
    "accuracy": using(
        "scored",
        select="""SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 6)
                         AS accuracy FROM scored""",
    ),
    "auc": using("scored", select=_auc_sql("scored", "p1", "label = 1")),
    "auc_tied": _auc_sql("lineitem", "l_quantity", "l_returnflag = 'R'"),
}
