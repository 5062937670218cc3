from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from affinity.functions import vectors as fn
from affinity.operators import features
from affinity.operators.embedding import article_embedding
from affinity.sources import schemas
from affinity.sources.tables import scan_article_terms


def by_key(df):
    return {r[0]: list(r[1]) for r in df.collect()}


def test_user_slots_and_age_groups(spark):
    rows = [
        (1, "F", 27, "a.com"), (2, "F", 48, "a.com"), (3, "M", 78, "b.com"),
        (4, "F", 0, "b.com"), (5, "M", 16, "a.com"), (6, "F", 54, "c.com"),
    ]
    got = by_key(features.user_features(spark.createDataFrame(rows, schemas.USER_BASE)))
    assert got == {
        1: [1.0, 1.0, 0.0, 0.4], 2: [1.0, 1.0, 0.0, 0.6], 3: [0.0, 0.0, 1.0, 1.0],
        4: [1.0, 0.0, 1.0, 0.0], 5: [0.0, 1.0, 0.0, 0.2], 6: [1.0, 0.0, 0.0, 0.8],
    }


def test_age_outside_the_groups_is_an_error(spark):
    rows = [(1, "F", -1, "a.com"), (2, "M", 3, "b.com")]
    with pytest.raises(Exception, match="(?i)bucketizer"):
        features.user_features(spark.createDataFrame(rows, schemas.USER_BASE)).collect()


def test_article_slots(spark):
    # The extremes give the scale; the golden row is (348, 0, 25).
    rows = [
        (1, 0, 0, "x", 11), (2, 20355, 106, "x", 27), (3, 348, 0, "y", 25), (4, 0, 0, "z", 11),
    ]
    got = by_key(features.article_features(spark.createDataFrame(rows, schemas.ARTICLE_BASE)))
    assert got[3][:3] == pytest.approx([0.01709653647752395, 0.0, 0.875], abs=1e-6)
    assert got[1] == [0.0, 0.0, 0.0, 1.0, 0.0]
    assert got[4][3:] == [0.0, 0.0]
    assert all(0 <= x <= 1 for v in got.values() for x in v)


def test_constant_column_and_rarest_type(spark):
    rows = [(1, 5, 1, "x", 3), (2, 5, 2, "y", 3)]
    got = by_key(features.article_features(spark.createDataFrame(rows, schemas.ARTICLE_BASE)))
    assert got == {1: [0.5, 0.0, 0.5, 1.0], 2: [0.5, 1.0, 0.5, 0.0]}


def test_a_single_type_is_an_error(spark):
    rows = [(1, 5, 1, "x", 3), (2, 5, 2, "x", 3)]
    with pytest.raises(Exception, match="two distinct values"):
        features.article_features(spark.createDataFrame(rows, schemas.ARTICLE_BASE))


@pytest.mark.parametrize("partitions", [None, 7])
def test_index_of_twenty_thousand_values(spark, partitions):
    rows = spark.range(20_500).select((F.col("id") % 20_000).cast("string").alias("c"))
    got = {r["c"]: r["c_index"] for r in features.category_index(rows, "c", partitions).collect()}
    order = sorted(map(str, range(500))) + sorted(map(str, range(500, 20_000)))
    assert got == {value: float(i) for i, value in enumerate(order)}
    wide = rows.join(features.category_index(rows, "c", partitions), "c").where("c = '3'").limit(1)
    vector = wide.select(features.to_dense(features.one_hot("c_index", 20_000)).alias("v")).first().v
    assert len(vector) == 19_999 and sum(vector) == 1 and vector[int(got["3"])] == 1


def test_missing_category_is_an_error(spark):
    rows = spark.createDataFrame([("a",), (None,)], "c string")
    with pytest.raises(Exception, match="c is missing"):
        features.category_index(rows, "c").collect()


def test_missing_number_is_an_error(spark):
    rows = [(1, 5, 1, "x", 3), (2, None, 2, "y", 4), (3, 8, 2, "y", 4)]
    with pytest.raises(Exception, match="article_num is missing"):
        features.article_features(spark.createDataFrame(rows, schemas.ARTICLE_BASE)).collect()


def test_embedding_is_the_mean_of_present_vectors(spark):
    rows = [(1, "a", [1.0, 2.0]), (1, "b", [3.0, 6.0]), (1, "c", None), (2, "d", [0.5, 0.5])]
    terms = scan_article_terms(spark.createDataFrame(rows, schemas.ARTICLE_TERMS))
    assert by_key(article_embedding(terms)) == {1: [2.0, 4.0], 2: [0.5, 0.5]}


@pytest.mark.parametrize(
    "text, vector",
    [
        ("[1.0,0.5]", [1.0, 0.5]), (" [ 1 , 2e-3 ] ", [1.0, 0.002]), ("[]", []),
        ("(3,[0,2],[1.0,-0.5])", [1.0, 0.0, -0.5]), ("(2,[],[])", [0.0, 0.0]),
        ("( 2 , [ 1 ] , [ 4 ] )", [0.0, 4.0]), ("(0,[],[])", []),
        ("(19,[0,11,18],[1.0,1.0,0.6])", [1.0] + [0.0] * 10 + [1.0] + [0.0] * 6 + [0.6]),
    ],
)
def test_vector_texts(spark, text, vector):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(fn.parse_vector(F.col("t")).alias("v"), fn.vector_width(F.col("t")).alias("n"))
    assert row.first() == (vector, len(vector))


def test_mixed_forms_in_one_column(spark):
    df = spark.createDataFrame([("[1.0,2.0]",), ("(2,[1],[3.0])",)], "t string")
    assert [r.v for r in df.select(fn.parse_vector(F.col("t")).alias("v")).collect()] == [
        [1.0, 2.0], [0.0, 3.0],
    ]


def test_malformed_vector_is_an_error(spark):
    df = spark.createDataFrame([("[1.0,x]",)], "t string")
    with pytest.raises(Exception, match="(?i)cast"):
        df.select(fn.parse_vector(F.col("t"))).collect()


def test_texts_round_trip_and_merge(spark):
    df = spark.createDataFrame([([1.0, 0.25], [4.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        fn.vector_to_text(a).alias("plain"), fn.vector_to_text(a, 3).alias("fixed"),
        fn.merge_feature_texts(fn.vector_to_text(a), fn.vector_to_text(b)).alias("texts"),
        fn.merge_features(a, b).alias("arrays"), fn.strip_brackets(fn.vector_to_text(a)).alias("s"),
    ).first()
    assert row == ("[1.0,0.25]", "[1.000,0.250]", "[1.0,0.25,4.0]", [1.0, 0.25, 4.0], "1.0,0.25")


def test_vector_columns_number_on_and_check_width(spark):
    df = spark.createDataFrame([(9, [1.0, 2.0], [3.0])], "id int, a array<double>, b array<double>")
    wide = fn.vector_columns(df, "a", "b")
    assert wide.columns == ["id", "f1", "f2", "f3"]
    assert wide.first() == (9, 1.0, 2.0, 3.0)
    uneven = df.union(spark.createDataFrame([(8, [1.0], [3.0])], df.schema))
    with pytest.raises(ValueError, match="between 1 and 2"):
        fn.vector_columns(uneven, "a")
    with pytest.raises(ValueError, match="no vectors"):
        fn.common_width(df.limit(0), "a")
