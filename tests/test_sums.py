"""Exact sums, the same bits whatever the order, and the blocked product against the join."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinity.functions.sums import exact_sum, exact_unit_sum
from affinity.operators import blocked, embedding, itemcf, ratings, similarity
from affinity.sources import schemas, standins
from test_itemcf import brute_force, invented, skewed_rows

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e6])
def test_exact_sum_is_the_sum(spark, scale):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * scale for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    got = df.agg(exact_sum(F.col("v")), exact_unit_sum(F.col("v") / (2000 * scale))).first()
    assert got[0] == pytest.approx(math.fsum(values), rel=1e-9, abs=1e-16)
    assert got[1] == pytest.approx(math.fsum(values) / 2000 / scale, abs=1e-15)


def test_sums_of_nothing_are_null(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert df.agg(exact_sum(F.col("v")), exact_unit_sum(F.col("v"))).first() == (None, None)


def test_a_sum_beyond_its_range_is_an_error(spark):
    df = spark.createDataFrame([(3e9,)], "v double")
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        df.agg(exact_sum(F.col("v"))).collect()


def _everything(spark, parts):
    """Ratings, means, similarities and scores, with the input dealt to ``parts`` at random."""
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    actions = standins.user_actions(spark, SF_DIR).repartition(parts, F.rand(parts))
    rated = ratings.user_item_ratings(actions, standins.AS_OF, standins.WEIGHTS)
    rated = rated.repartition(parts, F.rand(parts))
    near = similarity.item_similarity(rated)
    terms = standins.article_terms(spark, SF_DIR).repartition(parts, F.rand(parts))
    joined = itemcf.rating_similarity_join(rated, similarity.symmetric(near))
    return [
        rows_of(rated), rows_of(similarity.item_norms(rated)), rows_of(near), rows_of(itemcf.unseen_scores(joined, rated)),
        rows_of(itemcf.best_unseen_blocked(rated, 30, similarity=near)),
        sorted((r[0], tuple(r[1])) for r in embedding.article_embedding(terms).collect()),
    ]


def test_same_bits_for_any_number_of_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        first, *others = [_everything(spark, parts) for parts in (3, 17, 211)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(first)
    assert all(other == first for other in others)


@pytest.mark.parametrize(
    "rows, tile, block, k", [(None, 20, 7, 3), (skewed_rows(), 10**6, 10**6, 3), (skewed_rows(), 900, 100, 3), (skewed_rows(), 900, 100, 200)]
)
def test_blocked_top_k_is_the_join_top_k(spark, rows, tile, block, k):
    df = invented(spark) if rows is None else spark.createDataFrame(rows, schemas.RATINGS)
    near = similarity.item_similarity(df)
    found = blocked.tile_candidates(df, near, k, 6, entries_per_tile=tile, ratings_per_block=block)
    got = itemcf.top_k(found, k, score=F.round("pred_rating", 6)).collect()
    expected = itemcf.best_unseen(df, k, F.round("pred_rating", 6), similarity.symmetric(near)).collect()
    ranks = {(r.uid, r.rank): r.sim_aid for r in expected}
    assert ranks and {(r.uid, r.rank): r.sim_aid for r in got} == ranks
    scores = {(r.uid, r.sim_aid): r.pred_rating for r in expected}
    assert {(r.uid, r.sim_aid): r.pred_rating for r in got} == pytest.approx(scores)
    if k == 200:
        assert scores == pytest.approx(brute_force([tuple(r) for r in df.collect()])[1])


@pytest.mark.parametrize("products, sums", [(5, 7), (1 << 21, 1 << 21)])
def test_pieces_of_a_tile_do_not_change_it(monkeypatch, products, sums):
    """Heavy users cut into pieces, ties at the edge of k, weights that cancel out."""
    monkeypatch.setattr(blocked, "_PRODUCTS", products)
    monkeypatch.setattr(blocked, "_SUMS", sums)
    rng = np.random.default_rng(1)
    dense = rng.integers(-2, 3, (30, 30)) / 4
    item, near = np.nonzero(dense)
    rated = {u: sorted(rng.choice(30, rng.integers(1, 25), replace=False).tolist()) for u in range(12)}
    uid, aid = (np.array(x) for x in zip(*[(u, a) for u, items in rated.items() for a in items]))
    rating = rng.integers(0, 4, len(uid)).astype(float)
    tile = blocked._Tile(item, near, dense[item, near])
    got = {}
    for low, high in blocked._chunks(uid, tile.rows(aid)[1], len(tile.columns)):
        for u, i, s in zip(*tile.best(uid[low:high], aid[low:high], rating[low:high], 6, None)):
            got.setdefault(int(u), []).append((int(i), None if np.isinf(s) else float(s)))
    for u, items in rated.items():
        r = dict(zip(items, rating[uid == u]))
        scores = {}
        for b in range(30):
            met = [a for a in items if dense[a, b]]
            if met and b not in items:
                weight = sum(dense[a, b] for a in met)
                scores[b] = sum(r[a] * dense[a, b] for a in met) / weight if weight else None
        ranked = sorted(scores, key=lambda b: (scores[b] is None, -(scores[b] or 0), b))[:6]
        assert [i for i, _ in got.get(u, [])] == ranked
        assert [s for _, s in got.get(u, [])] == pytest.approx([scores[b] for b in ranked])


def test_blocked_plan_has_one_shuffle_before_the_ranks(spark):
    df = invented(spark)
    plan = itemcf.best_unseen_blocked(df, 3, similarity=similarity.item_similarity(df))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "WindowGroupLimit" in above and "Join" not in above


def test_ratings_go_by_a_tile_without_being_held():
    """Users are scored as they come, so blocks of users need not be many; ids of any size."""
    near = [(1, 2, 0.5), (2, 1, 0.5), (2, -(2**40), 0.25), (-(2**40), 2, 0.25)]
    packed = blocked._pack(*(np.array(x, kind) for x, kind in zip(zip(*near), ("i8", "i8", "f8"))))
    taken = []

    def stream():
        yield blocked._row([0], len(near), packed)
        for user in range(5):
            taken.append(user)
            yield blocked._row([1], 1, blocked._pack(np.array([user]), np.array([2]), np.array([3.0])))

    found = blocked._scored(stream(), 2, None)
    first = next(found)
    assert taken == [0]
    assert first.to_pylist() == [{"uid": 0, "sim_aid": i, "pred_rating": 3.0} for i in (-(2**40), 1)]
    assert [batch.column("uid")[0].as_py() for batch in found] == [1, 2, 3, 4]


def test_users_are_packed_whole(monkeypatch):
    monkeypatch.setattr(blocked, "_PACKED", 4)
    uid = np.repeat([3, 5, 9, 1], [2, 9, 1, 3])
    rows = [uid, np.arange(15), np.arange(15) / 2, np.repeat([0, 0, 0, 1], [2, 9, 1, 3])]
    batches = [pa.record_batch([pa.array(x[low : low + 2]) for x in rows], list("abcd")) for low in range(0, 15, 2)]
    got = [row for batch in blocked._packed_users(iter(batches), 2, 2) for row in batch.to_pylist()]
    for tile in (0, 1):
        mine = [(r["slot"], *blocked._unpack(r["data"], r["n"], "i8", "i8", "f8")) for r in got if r["slot"] // 2 % 2 == tile]
        for column, at in zip(rows, (1, 2, 3)):
            assert np.concatenate([x[at] for x in mine]).tolist() == column.tolist()
        assert all(slot % 2 == 1 and (slot // 4 == 1) == (1 in users) for slot, users, *_ in mine)
        users = [set(x[1].tolist()) for x in mine]
        assert sum(map(len, users)) == 4
