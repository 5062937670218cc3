"""The jobs chained through their tables, on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from affinity.operators import export, ranking
from affinity.plans import jobs
from affinity.queries.features import labelled_csv
from affinity.sources import standins

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables here")


def test_jobs_end_to_end(spark, tmp_path):
    sink = jobs.Sink(str(tmp_path / "cells"), table_path=str(tmp_path / "tables"))
    actions = standins.user_actions(spark, SF_DIR)
    log = (actions, standins.AS_OF, sink)
    itemcf, itemcf_rmse = jobs.run_itemcf(*log, k=20, weights=standins.WEIGHTS)
    als, als_rmse = jobs.run_als(*log, weights=standins.WEIGHTS)
    users = jobs.run_user_features(standins.user_base(spark, SF_DIR), sink)
    articles = jobs.run_article_features(standins.article_base(spark, SF_DIR), sink)
    terms = jobs.run_embedding(standins.article_terms(spark, SF_DIR), sink)
    jobs.union_features(itemcf, als, users, articles, terms, sink)
    ranker = jobs.train_ranker(standins.training(spark, SF_DIR), users, articles, terms, sink)
    small = jobs.train_csv_ranker(spark, labelled_csv(spark, SF_DIR), sink)

    assert 0 < itemcf_rmse.first().rmse < 1 and als_rmse.first().rmse > 0
    assert itemcf.groupBy("uid").count().agg(F.max("count")).first()[0] <= 20
    width = len(users.first().features) + len(articles.first().features) + 64
    assert ranker.model.count() == width + 1
    assert small.model.where(F.col("feature") != ranking.INTERCEPT).count() == 64
    assert ranker.loss.count() > 1
    assert {r.metric for r in ranker.metrics.collect()} == {"accuracy", "auc"}

    qualifiers = {}
    for name in ("itemcf", "als", "user_base", "article_base", "embedding", "user_features",
                 "itemcf_features", "als_features"):
        cells = export.read_cells(spark, str(tmp_path / "cells" / name))
        assert cells.count() == cells.select("rowkey").distinct().count() > 0
        qualifiers[name] = cells.first().qualifier
    assert qualifiers == {
        "itemcf": "itemcf", "als": "als", "user_base": "base", "article_base": "base",
        "embedding": "embedding", "user_features": "uf", "itemcf_features": "itemcf",
        "als_features": "als",
    }
