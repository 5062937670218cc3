"""Similarity above a least value, against the whole similarity."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinity.operators import cells, similarity
from affinity.plans.staging import stage
from affinity.sources import schemas


def ratings_of(spark, seed):
    """Sparse ratings with some heavy users, alike items, a repeated column and zeros."""
    rng = random.Random(seed)
    rows = {(u, i): rng.choice([0.0, 1.0, 2.0, 5.0]) for u in range(3) for i in range(60)}
    for i in range(60):
        for u in rng.sample(range(3, 80), rng.randrange(1, 9)):
            rows[u, i] = rng.choice([1.0, 3.0, 9.0])
    for u, i in list(rows):
        if i < 20 and rng.random() < 0.8:
            rows[u, 100 + i] = rows[u, i] * 2
    rows |= {(u, 200): 1.0 for u in range(90)} | {(5, 300): 4.0, (5, 301): 4.0}
    return stage(spark.createDataFrame([(u, i, r) for (u, i), r in rows.items()], schemas.RATINGS), "sparse")


def bits(df):
    return sorted((r.aid, r.sim_aid, r.sim.hex()) for r in df.collect())


@pytest.mark.parametrize("least, tile, most", [(0.05, 2000, 5_000_000), (0.3, 7, 40), (0.6, 7, 40), (0.9, 2000, 40)])
def test_equals_the_whole_similarity(spark, least, tile, most):
    rated = ratings_of(spark, 5)
    whole = [row for row in bits(similarity.item_similarity(rated)) if float.fromhex(row[2]) >= least]
    assert bits(similarity.similarity_at_least(rated, least, tile, most)) == whole and whole


def test_pairs_of_one_direction(spark):
    rated = stage(spark.createDataFrame([(1, 1, 2.0), (1, 2, 7.0), (2, 3, 1.0), (2, 4, 0.0)], schemas.RATINGS), "one")
    assert bits(similarity.similarity_at_least(rated, 1.0)) == [(1, 2, (1.0).hex())]
    assert similarity.similarity_at_least(rated.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        similarity.similarity_at_least(rated, 0.0)


def test_heavy_users_make_few_candidates(spark):
    rng = random.Random(2)
    rows = [(u, i, 1.0) for u in range(3) for i in range(400)]
    rows += [(u, i, 3.0) for i in range(400) for u in rng.sample(range(3, 2000), 4)]
    rated = stage(spark.createDataFrame(rows, schemas.RATINGS), "heavy")
    unit = stage(similarity.unit_columns(rated), "unit")
    assert similarity.item_similarity(rated).count() == 400 * 399 / 2
    candidates = {(r.aid, r.sim_aid) for r in similarity.candidate_pairs(unit, 0.4).collect()}
    assert {row[:2] for row in bits(similarity.similarity_at_least(rated, 0.4))} <= candidates
    assert 0 < len(candidates) < 400 * 399 / 2 / 50


@pytest.mark.parametrize("rows", [1, 2, 3])
def test_sums_by_cell_are_those_of_the_join(spark, monkeypatch, rows):
    """Bit for bit, in one cell or many, with products cut anywhere, and no pair shuffled."""
    rated = ratings_of(spark, rows)
    whole, near = bits(similarity.item_similarity(rated)), bits(similarity.similarity_at_least(rated, 0.3))
    monkeypatch.setattr(similarity, "CELLS_FROM", 1)
    monkeypatch.setattr(similarity, "INDEX_SAVES", 1e9)
    assert similarity._cell_tiles(rated, "rating", 4) > 1
    assert bits(similarity.item_similarity(rated, most_per_task=4)) == whole
    assert bits(similarity.similarity_at_least(rated, 0.3, most_per_task=4)) == near
    unit = stage(similarity.unit_columns(rated), "unit")
    for tiles in (1, 2, 5):
        assert bits(cells.cell_sums(unit, tiles)) == whole
    plan = similarity.item_similarity(rated, most_per_task=4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sim_aid" not in plan.split("MapInArrow", 1)[1].split("Exchange", 1)[1]


@pytest.mark.parametrize("scale", [1.0, 1 / 3])
def test_sums_by_list_are_those_of_the_join(spark, monkeypatch, scale):
    """Bit for bit, with any number of tiles, lists cut anywhere, and whole or broken ratings."""
    rated = stage(ratings_of(spark, 4).withColumn("rating", F.col("rating") * scale), "scaled")
    whole, near = bits(similarity.item_similarity(rated)), bits(similarity.similarity_at_least(rated, 0.3))
    unit = stage(similarity.unit_columns(rated), "unit")
    for tiles in (1, 4, 41):
        assert bits(cells.list_sums(unit, tiles)) == whole
        assert bits(cells.list_sums(unit, tiles, 0.3)) == near
    monkeypatch.setattr(similarity, "CELLS_FROM", 1)
    monkeypatch.setattr(similarity, "INDEX_SAVES", 1e9)
    monkeypatch.setattr(similarity, "ENTRIES_PER_CELL", 10)
    monkeypatch.setattr(similarity, "cell_sums", None)
    assert bits(similarity.item_similarity(rated, most_per_task=4)) == whole
    assert bits(similarity.similarity_at_least(rated, 0.3, most_per_task=4)) == near


def test_an_entry_is_sent_once_for_each_other_item_at_most(monkeypatch):
    """Not once a tile, and of two entries of a user only one to the other."""
    monkeypatch.setattr(cells, "_PRODUCTS", 7)
    uid, aid = (np.array(x) for x in zip(*[(u, 10 * u + i) for u in range(20) for i in range(5)]))
    columns = [uid, aid, np.ones(100), np.full(100, 3.0), (aid * 7 % 101).astype(np.int32)]
    batches = [pa.record_batch([pa.array(x) for x in columns], list("abcde"))]
    sent = [row for batch in cells._lists(iter(batches), 101) for row in batch.to_pylist()]
    assert sum(row["n"] for row in sent if row["side"] == 0) == 100
    assert sum(row["n"] for row in sent if row["side"] == 1) == 20 * 5 * 4 / 2


def test_products_of_an_item_are_cut(monkeypatch):
    monkeypatch.setattr(cells, "_PRODUCTS", 3)
    rng = np.random.default_rng(1)
    uid, aid, w = rng.integers(0, 9, 60), rng.integers(0, 12, 60), rng.random(60) / 60
    even = aid % 2 == 0
    for left, right in (((uid, aid, w), None), ((uid[even], aid[even], w[even]), (uid[~even], aid[~even], w[~even]))):
        sums = {}
        for i in range(60):
            for j in range(60):
                met = aid[i] < aid[j] if right is None else even[i] and not even[j]
                if met and uid[i] == uid[j]:
                    pair = tuple(sorted((int(aid[i]), int(aid[j]))))
                    sums[pair] = sums.get(pair, 0) + int(np.rint(w[i] * w[j] * 2.0**62))
        got = [row for batch in cells._sums(left, right, None) for row in batch.to_pylist()]
        assert {(r["aid"], r["sim_aid"]): r["sim"] for r in got} == {pair: n / 2.0**62 for pair, n in sums.items()}
        assert len(got) == len(sums)


def test_cells_refuse_what_would_overflow():
    uid, aid, w = np.zeros(4, np.int64), np.array([1, 1, 2, 2]), np.full(4, 0.8)
    with pytest.raises(ArithmeticError):
        list(cells._sums((uid, aid, w), None, None))
    with pytest.raises(ArithmeticError):
        list(cells._sums((uid[1:3], aid[1:3], np.array([1.0, np.nan])), None, None))
