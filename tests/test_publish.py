"""Published versions: what readers see while a table changes or a write fails."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from affinity.operators import publish


def names(root):
    return sorted(p.name for p in Path(root).iterdir())


def test_readers_keep_their_version(spark, tmp_path):
    root = str(tmp_path / "t")
    first = publish.publish_table(spark.range(5).selectExpr("id", "id * 2 AS twice"), "p_readers", root)
    second = publish.publish_table(spark.range(9).selectExpr("id", "id * 3 AS twice"), "p_readers", root)
    assert first.count() == 5 and second.count() == spark.table("p_readers").count() == 9
    assert first.agg(F.sum("twice")).first()[0] == 20
    assert publish.published_path(spark, "p_readers").endswith("v0000000002")


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    root = str(tmp_path / "t")
    publish.publish_table(spark.range(100), "p_failed", root)
    broken = F.when(F.col("id") == 70, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).cast("long")
    with pytest.raises(Exception, match="bad row"):
        publish.publish_table(spark.range(0, 100, 1, 4).select(broken.alias("id")), "p_failed", root)
    assert spark.table("p_failed").count() == 100 and names(root) == ["v0000000001"]
    assert publish.publish_table(spark.range(3), "p_failed", root).count() == 3


def test_old_versions_go(spark, tmp_path):
    root = tmp_path / "t"
    for n in range(1, 5):
        publish.publish_table(spark.range(n), "p_old", str(root), keep=2)
    assert names(root) == ["v0000000003", "v0000000004"]
    (root / "v0000000005").mkdir()
    (root / "notes").mkdir()
    # What a lost driver left counts for nothing and goes with the next write.
    publish.publish_table(spark.range(6), "p_old", str(root), keep=2)
    assert names(root) == ["notes", "v0000000004", "v0000000006"]
    with pytest.raises(ValueError):
        publish.publish_table(spark.range(1), "p_old", str(root), keep=0)


def test_a_table_may_be_made_from_itself(spark, tmp_path):
    root = str(tmp_path / "it's a root")
    publish.publish_table(spark.range(4), "p_self", root)
    table = spark.table("p_self")
    assert publish.publish_table(table.union(table), "p_self", root).count() == 8


def test_other_columns_and_formats(spark, tmp_path):
    root = str(tmp_path / "t")
    publish.publish_table(spark.range(4), "p_form", root)
    wide = publish.publish_table(spark.range(4).withColumn("x", F.lit("a")), "p_form", root)
    assert wide.columns == ["id", "x"] and wide.count() == 4
    parquet = publish.publish_table(wide.limit(1), "p_form", root, fmt="parquet")
    assert parquet.count() == 1 and spark.table("p_form").columns == ["id", "x"]
    empty = publish.publish_table(wide.limit(0), "p_form", root, fmt="parquet")
    assert empty.count() == 0 and empty.columns == ["id", "x"]
