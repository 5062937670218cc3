from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

from affinity.operators import candidates, itemcf, similarity
from affinity.operators.als import explode_recommendations
from affinity.operators.ratings import hash_split
from affinity.plans import staging
from affinity.queries import recall
from affinity.sources import schemas

# An invented table: seven users, six items, every pair of items shared by somebody or nobody.
RATINGS = [
    (11, 1, 4.0), (11, 2, 1.0), (11, 3, 2.0),
    (12, 1, 1.0), (12, 4, 3.0),
    (13, 2, 5.0), (13, 3, 0.5), (13, 5, 2.5),
    (14, 3, 1.5), (14, 4, 4.0), (14, 5, 1.0),
    (15, 1, 2.0), (15, 5, 3.0),
    (16, 2, 3.5), (16, 4, 0.5), (16, 6, 4.5),
    (17, 6, 2.0),
]


def invented(spark):
    return spark.createDataFrame(RATINGS, schemas.RATINGS)


def pairs_of(df):
    return {(r.aid, r.sim_aid): r.sim for r in df.collect()}


def brute_force(rows):
    """Scores of unseen items from plain Python loops."""
    by_item, by_user = defaultdict(dict), defaultdict(dict)
    for uid, aid, rating in rows:
        by_item[aid][uid] = rating
        by_user[uid][aid] = rating
    norm = {a: sum(r * r for r in col.values()) ** 0.5 for a, col in by_item.items()}
    sim = {}
    for a in by_item:
        for b in by_item:
            shared = [u for u in by_item[a] if u in by_item[b]]
            dot = sum(by_item[a][u] * by_item[b][u] for u in shared)
            if a != b and dot:
                sim[a, b] = dot / norm[a] / norm[b]
    scores = {}
    for u, seen in by_user.items():
        for b in by_item:
            near = [(r, sim[a, b]) for a, r in seen.items() if (a, b) in sim]
            if near and b not in seen:
                scores[u, b] = sum(r * s for r, s in near) / sum(s for _, s in near)
    return sim, scores


def skewed_rows(seed=5):
    """One user with most of the ratings, one item rated by everyone, and some zeros."""
    rng = random.Random(seed)
    rows = {(0, aid): rng.choice([0.5, 1.0, 2.0, 0.0]) for aid in range(60)}
    for uid in range(1, 40):
        rows[uid, 3] = rng.random()
        for aid in rng.sample(range(60), 4):
            rows[uid, aid] = rng.choice([0.0, rng.random()])
    return [(u, a, r) for (u, a), r in rows.items()]


def expected_lists():
    """Unseen items of each user, best first, from plain loops."""
    lists = defaultdict(list)
    for (uid, aid), score in brute_force(RATINGS)[1].items():
        lists[uid].append((aid, round(score, 6)))
    return {uid: sorted(x, key=lambda p: (-p[1], p[0])) for uid, x in lists.items()}


def test_similarity_of_the_invented_table(spark):
    got = pairs_of(similarity.item_similarity(invented(spark)))
    expected = {k: v for k, v in brute_force(RATINGS)[0].items() if k[0] < k[1]}
    assert got == pytest.approx(expected)


def test_zero_ratings_form_no_pair(spark):
    rows = [*RATINGS, (18, 7, 0.0), (18, 1, 3.0), (18, 6, 0.0)]
    got = pairs_of(similarity.item_similarity(spark.createDataFrame(rows, schemas.RATINGS)))
    assert got.keys() == pairs_of(similarity.item_similarity(invented(spark))).keys()


def test_similarity_agrees_with_the_matrix_library(spark):
    rows = skewed_rows()
    entries = spark.sparkContext.parallelize([MatrixEntry(u, a, r) for u, a, r in rows])
    library = CoordinateMatrix(entries).toRowMatrix().columnSimilarities().entries.collect()
    expected = {(min(e.i, e.j), max(e.i, e.j)): e.value for e in library if e.value}
    got = pairs_of(similarity.item_similarity(spark.createDataFrame(rows, schemas.RATINGS)))
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("tile, per_task", [(2000, 20_000_000), (7, 100), (1, 10)])
def test_tiles_do_not_change_similarity(spark, tile, per_task):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, schemas.RATINGS)
    got = similarity.item_similarity(df, items_per_tile=tile, most_per_task=per_task)
    collected = got.collect()
    assert len(collected) == len({(r.aid, r.sim_aid) for r in collected})
    sim, _ = brute_force(rows)
    assert pairs_of(got) == pytest.approx({k: v for k, v in sim.items() if k[0] < k[1]})


def test_symmetric_holds_both_directions(spark):
    both = pairs_of(similarity.symmetric(similarity.item_similarity(invented(spark))))
    assert len(both) == 2 * similarity.item_similarity(invented(spark)).count()
    assert all(both[b, a] == s and 0 < s <= 1 + 1e-12 for (a, b), s in both.items())


def test_best_unseen_of_the_invented_table(spark):
    got = defaultdict(list)
    for r in itemcf.best_unseen(invented(spark)).orderBy("uid", "rank").collect():
        got[r.uid].append((r.sim_aid, round(r.pred_rating, 6)))
    assert got == expected_lists()


def test_top_k_ranks_without_gaps_and_breaks_ties_by_item(spark):
    rows = [(1, aid, float(aid % 3)) for aid in range(20)] + [(2, 5, 1.0)]
    df = spark.createDataFrame(rows, schemas.ITEMCF)
    got = itemcf.top_k(df, 4).orderBy("uid", "rank").collect()
    assert [(r.uid, r.sim_aid, r.rank) for r in got] == [
        (1, 2, 1), (1, 5, 2), (1, 8, 3), (1, 11, 4), (2, 5, 1),
    ]


@pytest.mark.parametrize("per_task", [20_000_000, 500, 60])
def test_scores_match_brute_force_with_hot_items(spark, per_task):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, schemas.RATINGS)
    sims = similarity.symmetric(similarity.item_similarity(df, items_per_tile=7))
    joined = itemcf.rating_similarity_join(df, sims, per_task)
    expected = pytest.approx(brute_force(rows)[1])
    for scored in (
        itemcf.drop_seen(itemcf.item_scores(joined), df), itemcf.unseen_scores(joined, df),
    ):
        assert {(r.uid, r.sim_aid): r.pred_rating for r in scored.collect()} == expected


@pytest.mark.parametrize("per_task", [20_000_000, 60])
def test_scores_do_not_depend_on_how_similarities_are_sent(spark, per_task):
    df = spark.createDataFrame(skewed_rows(), schemas.RATINGS)
    sims = similarity.symmetric(similarity.item_similarity(df))
    sent, met = (
        sorted(map(tuple, itemcf.rating_similarity_join(df, sims, per_task, most).collect())) for most in (10**6, 0)
    )
    assert sent and sent == met


def test_the_sums_of_a_user_need_no_shuffle_of_joined_rows(spark):
    df = staging.stage(spark.createDataFrame(skewed_rows(), schemas.RATINGS), "ratings")
    sims = similarity.symmetric(similarity.staged_similarity(df))
    scored = itemcf.item_scores(itemcf.rating_similarity_join(df, sims, 60))
    assert scored._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_unseen_scores_are_summed_before_seen_ones_are_dropped(spark):
    plan = recall.cf_unseen_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "HashAggregate" not in plan


@pytest.mark.parametrize("per_task", [20_000_000, 100])
def test_holdout_is_predicted_alike_with_and_without_all_scores(spark, per_task):
    train, holdout = hash_split(spark.createDataFrame(skewed_rows(), schemas.RATINGS))
    near = itemcf.neighbours(train)
    scores = itemcf.item_scores(itemcf.rating_similarity_join(train, near))
    full = itemcf.holdout_predictions(scores, holdout).collect()
    few = itemcf.predict_holdout(train, holdout, near, per_task).collect()
    assert full and {(r.uid, r.aid, r.rating): r.pred_rating for r in few} == pytest.approx(
        {(r.uid, r.aid, r.rating): r.pred_rating for r in full}
    )


def test_rsp_is_rating_times_similarity(spark):
    ratings = spark.createDataFrame(
        [(51876453, 9015927, 0.09002494812011719), (52015583, 9048856, 0.22506237030029297)],
        schemas.RATINGS,
    )
    sims = spark.createDataFrame(
        [(9015927, 9049026, 0.7453559924999298), (9048856, 9049649, 1.0)],
        "aid bigint, sim_aid bigint, sim double",
    )
    got = {r.uid: r.rsp for r in itemcf.rating_similarity_join(ratings, sims).collect()}
    assert got == {51876453: 0.06710063455582463, 52015583: 0.22506237030029297}


def test_holdout_predictions_keep_only_predicted_pairs(spark):
    scores = spark.createDataFrame([(1, 2, 0.5), (1, 3, None)], schemas.ITEMCF)
    holdout = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (9, 9, 1.0)], schemas.RATINGS)
    got = itemcf.holdout_predictions(scores, holdout).collect()
    assert [(r.uid, r.aid, r.rating, r.pred_rating) for r in got] == [(1, 2, 1.0, 0.5)]


def test_lists_are_best_first_and_explode_back(spark):
    top = itemcf.best_unseen(invented(spark)).drop("rank")
    lists = candidates.recommendation_lists(top, "sim_aid")
    got = {
        r.uid: [(x.aid, round(x.rating, 6)) for x in r.recommendations] for r in lists.collect()
    }
    assert got == expected_lists()
    back = {tuple(r) for r in explode_recommendations(lists).collect()}
    assert back == {tuple(r) for r in top.collect()}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_seen_filter_is_an_anti_join_and_top_k_is_limited_before_the_shuffle(spark):
    train = invented(spark)
    plan = plan_of(itemcf.drop_seen(invented(spark).withColumnRenamed("aid", "sim_aid"), train))
    assert "LeftAnti" in plan
    plan = plan_of(itemcf.best_unseen(train, 3))
    assert "partial_sum" in plan and "Anti" not in plan
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("BatchEvalPython") + plan.count("ArrowEvalPython") == 0


def test_nulls_in_ids_are_dropped_at_the_scan(spark):
    from affinity.sources.tables import scan_user_actions

    raw = spark.createDataFrame(
        [("1", "2", "点击", "20200715"), ("x", "2", "点击", "20200715"), ("1", None, "点击", "20200715")],
        "uid string, aid string, action string, action_date string",
    )
    got = scan_user_actions(raw)
    assert got.schema.simpleString() == "struct<uid:bigint,aid:bigint,action:string,action_date:string>"
    assert got.select("uid", "aid").collect() == [(1, 2)]
