from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from affinity.llm import gam_quality as op

LABELS = "doc_id long, quality int"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(30, 120))]
        bad = rng.random() < 0.3
        if bad:
            words = rng.choice([[w + "***" for w in words], [w.upper() + "!!" for w in words], words[:1] * 60])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    docs = documents(rows)
    model = op.train(op.with_features(docs, "doc_id"), spark.createDataFrame(labels, LABELS))
    got = {r["doc_id"]: r for r in op.scored(op.with_features(docs, "doc_id"), model).select("row.doc_id", "score", "predicted").collect()}
    test = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 50 and np.mean([got[i]["predicted"] == y for i, y in test]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= op.THRESHOLD) for r in got.values())


def test_labels_of_held_out_documents_do_not_matter(spark, documents):
    rows, labels = corpus(150)
    rows_of = op.with_features(documents(rows), "doc_id")
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    turned = [(i, 1 - y if i in held else y) for i, y in labels]
    a, b = (op.train(rows_of, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert all((x == y).all() for x, y in zip(a.tables, b.tables))


def test_score_is_the_sum_of_table_cells():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = op.fit(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9
    row = x[7]
    total = model.base + sum(t[np.searchsorted(model.edges[f], row[f], side="right")] for f, t in enumerate(model.tables))
    for (f, g), table in model.pairs.items():
        total += table[tuple(np.searchsorted(model.coarse[k], row[k], side="right") for k in (f, g))]
    assert model.score(x)[7] == pytest.approx(1 / (1 + np.exp(-total)))


def test_features_of_plain_texts():
    x = op.features(pa.array(["Ab 1* cd\nAb 1* cd", None, "", "!!"]))
    at = dict(zip(op.FEATURES, x[0]))
    assert at["log_words"] == pytest.approx(np.log1p(6)) and at["distinct_words"] == 0.5
    assert at["upper"] == pytest.approx(2 / 17) and at["digits"] == pytest.approx(2 / 17)
    assert at["dup_lines"] == 0.5 and at["repeated_runs"] == 0.25
    assert (x[1] == x[2]).all() and np.isfinite(x).all()


def test_odd_rows_and_labels(spark, documents, odd_rows):
    docs = documents(odd_rows)
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 0), (5, None), (7, 3), (99, 1)], LABELS)
    kept = op.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(odd_rows)
    model = op.train(op.with_features(docs, "doc_id"), labels.limit(0))
    scores = op.scored(op.with_features(docs, "doc_id"), model)
    assert [r["score"] for r in scores.collect()] == [0.5] * len(odd_rows)
    assert op.keep_good(documents([]), labels).count() == 0
