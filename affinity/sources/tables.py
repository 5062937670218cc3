"""Scans of the input tables, typed and pruned.

Each scan takes the raw table, whatever types its columns have, and returns the
declared schema. Ids and numbers that do not parse become null; rows without an
id are dropped, since nothing can join to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from affinity.sources import schemas


def open_table(
    spark: SparkSession, source: str, fmt: str | None = None, limit: int | None = None
) -> DataFrame:
    """A catalog table, or with ``fmt`` the files under a path; with ``limit`` any so many rows."""
    table = spark.table(source) if fmt is None else spark.read.format(fmt).load(source)
    return table if limit is None else table.limit(limit)


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` by name, each cast to its declared type."""
    fields = StructType.fromDDL(schema).fields
    return df.select([_cast(df, field.name, field.dataType) for field in fields])


def _cast(df: DataFrame, name: str, dtype) -> Column:
    column = F.col(name)
    if df.schema[name].dataType == dtype:
        return column
    return column.try_cast(dtype).alias(name)


def _present(df: DataFrame, *ids: str) -> DataFrame:
    for name in ids:
        df = df.where(F.col(name).isNotNull())
    return df


def scan_user_actions(raw: DataFrame) -> DataFrame:
    """Behaviour log: uid, aid, action, action_date (``yyyyMMdd``)."""
    return _present(typed(raw, schemas.USER_ACTIONS), "uid", "aid")


def scan_article_base(raw: DataFrame) -> DataFrame:
    """Article facts: character count, image count, type, days since publication."""
    return _present(typed(raw, schemas.ARTICLE_BASE), "article_id")


def scan_user_base(raw: DataFrame) -> DataFrame:
    """User profile: gender, age, email suffix."""
    return _present(typed(raw, schemas.USER_BASE), "uid")


def scan_article_terms(raw: DataFrame) -> DataFrame:
    """Word vectors of the top terms of each article, without the missing ones."""
    rows = typed(_present(raw, "vector"), schemas.ARTICLE_TERMS)
    return _present(rows, "article_id")


def scan_training(raw: DataFrame) -> DataFrame:
    """Labelled (uid, aid) samples."""
    return _present(typed(raw, schemas.TRAINING), "uid", "aid")


def scan_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row and text columns ``features`` and ``label``.

    Columns are taken by header name, so the file may hold others in any order.
    The label becomes an int, null where it is none.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select("features", F.col("label").try_cast("int").alias("label"))


def binary_labels(samples: DataFrame) -> DataFrame:
    """Samples labelled 0 or 1."""
    return samples.where(F.col("label").isin(0, 1))
