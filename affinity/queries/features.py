"""Registered queries: feature scans, transformers, vectors and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions import vectors as fn
from affinity.operators import features
from affinity.operators.ranking import nonempty
from affinity.plans.staging import new_path, stage
from affinity.queries import inputs
from affinity.queries.inputs import rounded, slots
from affinity.queries.sql import text, using
from affinity.sources import standins, tables


def scan_article_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.article_base(spark, sf_dir)


def scan_user_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.user_base(spark, sf_dir)


def scan_article_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = standins.article_terms(spark, sf_dir)
    exploded = terms.select("article_id", "top_term", F.posexplode("vector").alias("slot", "value"))
    return rounded(exploded, "value")


def scan_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.training(spark, sf_dir)


def labelled_csv(spark: SparkSession, sf_dir: str) -> str:
    """Path of a CSV of the embeddings, with a column more than needed and text labels."""
    path = new_path(spark, "labelled-csv")
    standins.read(spark, sf_dir, "embeddings").select(
        F.col("vec_id"),
        fn.vector_to_text(F.col("embedding").cast("array<double>"), 6).alias("features"),
        (F.col("label") % 3).alias("label"),
    ).write.option("header", True).csv(path)
    return path


def scan_csv_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_labelled_csv(spark, labelled_csv(spark, sf_dir))


def filter_binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.binary_labels(scan_csv_labelled(spark, sf_dir))


def filter_nonempty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings emptied or nulled for some labels, then filtered."""
    raw = standins.read(spark, sf_dir, "embeddings")
    holed = raw.select(
        "vec_id",
        F.when(F.col("label") == 1, F.array().cast("array<float>"))
        .when(F.col("label") != 2, F.col("embedding"))
        .alias("features"),
    )
    return nonempty(holed, "features").select("vec_id", F.size("features").alias("n"))


def string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = standins.user_base(spark, sf_dir)
    indexes = {c: features.category_index(profiles, c) for c in features.USER_CATEGORIES}
    rows = features.indexed(profiles, indexes)
    return rows.select("uid", "gender", "email_suffix", "gender_index", "email_suffix_index")


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = standins.article_base(spark, sf_dir)
    index = stage(features.category_index(facts, "type_name"), "index")
    vector = features.to_dense(features.one_hot("type_name_index", index.count()))
    return slots(facts.join(index, "type_name").select("article_id", vector.alias("v")), "article_id", "v")


def bucketize_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = features.age_bucketizer().transform(standins.user_base(spark, sf_dir))
    return grouped.select("uid", "age", F.col("age_group").cast("int").alias("age_group"))


def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = standins.article_base(spark, sf_dir)
    bounds = features.column_bounds(facts, *features.ARTICLE_NUMBERS)
    scaled = F.array(*[features.minmax(name, bounds) for name in features.ARTICLE_NUMBERS])
    return slots(facts.select("article_id", scaled.alias("v")), "article_id", "v")


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(inputs.user_vectors(spark, sf_dir), "uid", "features")


def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(inputs.article_vectors(spark, sf_dir), "article_id", "features")


def article_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(inputs.embeddings(spark, sf_dir), "article_id", "article_vector")


def merge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article vector and embedding as one text, merged as arrays and as texts."""
    both = inputs.article_vectors(spark, sf_dir).join(
        inputs.embeddings(spark, sf_dir), "article_id"
    )
    arrays = fn.merge_features(F.col("features"), F.col("article_vector"))
    texts = fn.merge_feature_texts(
        fn.vector_to_text(F.col("features"), 6), fn.vector_to_text(F.col("article_vector"), 6)
    )
    return both.select(
        "article_id",
        F.size(arrays).alias("n"),
        fn.vector_to_text(arrays, 6).alias("merged_arrays"),
        texts.alias("merged_texts"),
    )


def vector_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = inputs.user_vectors(spark, sf_dir)
    return vectors.select("uid", fn.vector_to_text(F.col("features")).alias("features"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = standins.read(spark, sf_dir, "embeddings")
    return raw.select("vec_id", fn.vector_to_text(F.col("embedding"), 6).alias("text"))


def _sparse_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot labels in sparse text form; label 9 is the empty vector."""
    hot = F.when(F.col("label") < 9, F.array("label")).otherwise(F.array().cast("array<int>"))
    ones = F.transform(hot, lambda _: F.lit("1.0"))
    return standins.read(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(
            F.lit("(9,["), F.concat_ws(",", hot.cast("array<string>")),
            F.lit("],["), F.concat_ws(",", ones), F.lit("])"),
        ).alias("text"),
    )


def vector_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _texts(spark, sf_dir).withColumn("form", F.lit("dense")).unionByName(
        _sparse_texts(spark, sf_dir).withColumn("form", F.lit("sparse"))
    )
    return both.select("vec_id", "form", fn.vector_width(F.col("text")).alias("width"))


def vector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _texts(spark, sf_dir).select("vec_id", fn.parse_vector(F.col("text")).alias("v"))
    return slots(parsed, "vec_id", "v")


def vector_parse_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _sparse_texts(spark, sf_dir).select(
        "vec_id", fn.parse_vector(F.col("text")).alias("v")
    )
    return slots(parsed, "vec_id", "v")


def vector_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embedding slots and the label pair as f1..f66."""
    raw = standins.read(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("head"),
        F.array(F.col("label") % 2, F.col("label") % 3).cast("array<double>").alias("tail"),
    )
    wide = fn.vector_columns(raw, "head", "tail")
    return rounded(wide, *[name for name in wide.columns if name != "vec_id"])


QUERIES = {
    f.__name__: f
    for f in (
        scan_article_base, scan_user_base, scan_article_terms, scan_training, scan_csv_labelled,
        filter_binary_label, filter_nonempty_features, string_index, one_hot, bucketize_age,
        minmax_scale, user_features, item_features, article_embedding, merge_features,
        vector_to_text, vector_width, vector_parse, vector_parse_sparse, vector_columns,
    )
}

_CSV = f"""SELECT {text("embedding")} AS features,
                  CAST(label % 3 AS INTEGER) AS label FROM embeddings"""


_SPREAD = ", ".join(f"round(embedding[{i}]::DOUBLE, 6) + 0.0 AS f{i}" for i in range(1, 65))


def _slots_sql(source: str, key: str, vector: str) -> str:
    """SQL twin of ``inputs.slots``; adding zero turns a rounded -0.0 into 0.0."""
    return f"""SELECT {key}, CAST(slot - 1 AS INTEGER) AS slot, round({vector}[slot], 6) + 0.0 AS value
        FROM (SELECT {key}, {vector}, unnest(range(1, len({vector}) + 1)) AS slot FROM {source})"""


ORACLES = {
    "scan_article_base": using("articles", select="SELECT * FROM articles"),
    "scan_user_base": using("profiles", select="SELECT * FROM profiles"),
    "scan_article_terms": using(
        "terms",
        select="""SELECT article_id, top_term, CAST(slot - 1 AS INTEGER) AS slot,
                         round(vector[slot], 6) + 0.0 AS value
            FROM (SELECT *, unnest(range(1, len(vector) + 1)) AS slot FROM terms)""",
    ),
    "scan_training": using("samples", select="SELECT * FROM samples"),
    "scan_csv_labelled": _CSV,
    "filter_binary_label": f"SELECT * FROM ({_CSV}) WHERE label = 0 OR label = 1",
    "filter_nonempty_features": """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n
        FROM embeddings WHERE label NOT IN (1, 2) AND len(embedding) > 0""",
    "string_index": using(
        "gender_index", "email_index",
        select="""SELECT p.uid, p.gender, p.email_suffix, g.idx::DOUBLE AS gender_index,
                         e.idx::DOUBLE AS email_suffix_index
            FROM profiles p JOIN gender_index g ON p.gender = g.value
            JOIN email_index e ON p.email_suffix = e.value""",
    ),
    "one_hot": using(
        "type_index",
        select="""SELECT a.article_id, CAST(slot AS INTEGER) AS slot,
                         CASE WHEN slot = t.idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
            FROM articles a JOIN type_index t ON a.type_name = t.value
            JOIN (SELECT idx AS slot FROM type_index
                  WHERE idx < (SELECT max(idx) FROM type_index)) s ON true""",
    ),
    "bucketize_age": using("aged", select="SELECT uid, age, age_group FROM aged"),
    "minmax_scale": using(
        "scaled",
        select="""SELECT article_id, 0 AS slot, round(sn, 6) AS value FROM scaled
            UNION ALL SELECT article_id, 1, round(si, 6) FROM scaled
            UNION ALL SELECT article_id, 2, round(sp, 6) FROM scaled""",
    ),
    "user_features": using(
        "user_vectors", select=_slots_sql("user_vectors", "uid", "features")
    ),
    "item_features": using(
        "article_vectors", select=_slots_sql("article_vectors", "article_id", "features")
    ),
    "article_embedding": using(
        "embedded", select=_slots_sql("embedded", "article_id", "article_vector")
    ),
    "merge_features": using(
        "article_vectors", "embedded",
        select=f"""SELECT article_id, CAST(len(merged) AS INTEGER) AS n,
                          {text("merged")} AS merged_arrays, {text("merged")} AS merged_texts
            FROM (SELECT v.article_id, list_concat(v.features, e.article_vector) AS merged
                  FROM article_vectors v JOIN embedded e ON v.article_id = e.article_id)""",
    ),
    "vector_to_text": using(
        "user_vectors",
        select="""SELECT uid, '[' || array_to_string(features, ',') || ']' AS features
                  FROM user_vectors""",
    ),
    "vector_width": """SELECT vec_id, 'dense' AS form, CAST(len(embedding) AS INTEGER) AS width
        FROM embeddings UNION ALL SELECT vec_id, 'sparse', 9 FROM embeddings""",
    "vector_parse": f"""SELECT vec_id, slot, value FROM (
        {_slots_sql("(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", "vec_id", "v")})""",
    "vector_parse_sparse": """SELECT vec_id, CAST(slot AS INTEGER) AS slot,
        CASE WHEN label = slot THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
        FROM embeddings CROSS JOIN range(0, 9) slots(slot)""",
    "vector_columns": f"""SELECT vec_id, {_SPREAD}, (label % 2)::DOUBLE AS f65,
        (label % 3)::DOUBLE AS f66 FROM embeddings""",
}
