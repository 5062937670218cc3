from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinity.llm import icws_dedup as op

MARKS = re.compile(r"[\W_]+")


def folded(text):
    words = (MARKS.sub("", w.lower()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return [w for w in words if w]


def runs(text):
    words = folded(text)
    if not words:
        return Counter()
    width = min(op.WIDTH, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(texts):
    """Similarity of every two texts, from the definition."""
    bags = [runs(t) for t in texts]
    frequency = Counter(run for bag in bags for run in bag)
    n = len(texts)

    def weight(run, times):
        hot = frequency[run] > n / op.RARE
        idf = min(1, max(0, np.log(n / frequency[run]) / np.log(op.RARE))) if hot else 1
        return (1 + np.log(times)) * (1 + op.IDF_SHARE * idf)

    weighed = [{run: weight(run, times) for run, times in bag.items()} for bag in bags]
    out = {}
    for i in range(n):
        for j in range(i):
            a, b = weighed[i], weighed[j]
            common = sum(min(a[r], b[r]) for r in a.keys() & b.keys())
            total = sum(a.values()) + sum(b.values()) - common
            out[i, j] = common / total if total else 0.0
    return out


def corpus(seed):
    """Originals, copies, near copies of several degrees, and a passage many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(14):
        words = [word() for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(words))
        for changes in rng.choices([0, 1, 2, 3, 8, 30], k=4):
            near = list(words)
            for _ in range(changes):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
    texts += [" ".join([word() for _ in range(60)] + passage) for _ in range(12)]
    texts += ["", " \n", "one two", "One, two!", "one two three"]
    rng.shuffle(texts)
    return texts


def classes_of(pairs, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_classes_equal_brute_force(spark, documents):
    texts = corpus(4)
    got, links = op.near_classes(documents([(i, t, "s") for i, t in enumerate(texts)]))
    found = {r["doc_id"]: r["class_id"] for r in got.collect()}
    near = [pair for pair, similarity in brute(texts).items() if similarity >= op.SIMILARITY]
    near += [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j]]
    assert found == dict(enumerate(classes_of(near, len(texts))))
    assert all(a > b for a, b in links.collect())
    kept = {r["doc_id"] for r in op.keep_one(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert kept == set(found.values())


def test_similarity_and_frequencies(spark, documents):
    texts = corpus(8)
    docs = documents([(i, t, "s") for i, t in enumerate(texts)])
    weights = op.Weights(len(texts), *op.frequent_shingles(docs, len(texts)))
    expected = brute(texts)
    pairs = list(expected)
    left, right = (pa.array([texts[p[k]] for p in pairs]) for k in (0, 1))
    assert op.similarity(left, right, weights) == pytest.approx([expected[p] for p in pairs])


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(1, 2**62, 300, dtype=np.uint64), rng.integers(1, 2**62, (2, 60), dtype=np.uint64)
    hits = []
    for trial in range(40):
        salt = np.uint64(trial * 7919)
        sides = [np.sort(np.concatenate([shared, x]) ^ salt) for x in own]
        keys = [op.signatures(np.zeros(360, np.int64), side, np.ones(360), 1)[0] for side in sides]
        hits.append((keys[0] == keys[1]).mean())
    assert np.mean(hits) == pytest.approx((300 / 420) ** op.ROWS, abs=0.05)


def test_weights_raise_the_agreement():
    rng = np.random.default_rng(5)
    hits = defaultdict(list)
    for trial in range(60):
        shared, a, b = (rng.integers(1, 2**62, n, dtype=np.uint64) for n in (50, 50, 50))
        for heavy in (1.0, 4.0):
            keys = []
            for own in (a, b):
                hashes = np.concatenate([shared, own])
                weights = np.concatenate([np.full(50, heavy), np.ones(50)])
                order = np.argsort(hashes)
                keys.append(op.signatures(np.zeros(100, np.int64), hashes[order], weights[order], 1)[0])
            hits[heavy].append((keys[0] == keys[1]).mean())
    for heavy, share in ((1.0, 50 / 150), (4.0, 200 / 300)):
        assert np.mean(hits[heavy]) == pytest.approx(share**op.ROWS, abs=0.05)


def test_odd_rows(spark, documents, odd_rows):
    got, _ = op.near_classes(documents(odd_rows))
    rows = sorted(map(repr, ((r["doc_id"], r["class_id"] if (r["class_id"] or 0) >= 0 else "none") for r in got.collect())))
    classes = {None: "none", 1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert rows == sorted(repr((i, classes[i])) for i, _, _ in odd_rows)
    kept = op.keep_one(documents(odd_rows))
    assert kept.columns == documents(odd_rows).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 8]


def test_a_large_group_of_near_copies_is_one_class(spark, documents):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words), "s"))
    got, _ = op.near_classes(documents(rows))
    assert {r["class_id"] for r in got.collect()} == {0}


def test_empty_table(spark, documents):
    assert op.near_classes(documents([]))[0].count() == 0
    assert op.keep_one(documents([])).count() == 0


def template_texts(n, seed):
    """Texts of one template, just under the limit, the last two just over it."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    template = [word() for _ in range(320)]
    texts = [[*template, *(word() for _ in range(34))] for _ in range(n)]
    texts.append([*texts[-1][:323], *(word() for _ in range(31))])
    return [" ".join(words) for words in texts]


def test_unlike_texts_of_one_bucket_all_meet(spark, documents):
    texts = template_texts(50, 0)
    near = brute(texts)
    assert [pair for pair, similarity in near.items() if similarity >= op.SIMILARITY] == [(50, 49)]
    got, links = op.near_classes(documents([(i, t, "s") for i, t in enumerate(texts)]))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {i: min(i, 49) for i in range(51)}
    assert [tuple(r) for r in links.collect()] == [(50, 49)]


def test_links_are_similar_and_connect_the_classes(spark, documents):
    texts = sorted(set(corpus(4)))
    got, links = op.near_classes(documents([(i, t, "s") for i, t in enumerate(texts)]))
    assert got.columns == ["digest", "doc_id", "class_id"]
    pairs, near = [tuple(r) for r in links.collect()], brute(texts)
    assert pairs and len(set(pairs)) == len(pairs) and all(near[pair] >= op.SIMILARITY for pair in pairs)
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == dict(enumerate(classes_of(pairs, len(texts))))


def test_a_link_between_two_members_that_do_not_lead(spark):
    members = [(1, i) for i in range(60)]
    found, rest, most, met = {}, members, 2, set()
    near = {(i, i - 1) for i in range(1, 60) if i % 10}
    schema = "key long, node long, total double, shared double, fame long, class long"
    table = op._unsettled(spark.createDataFrame([(k, i, 1.0, 1.0, 1, i) for k, i in members], schema))
    while not table.isEmpty():
        leaders = op._leaders(table, most)
        met |= {tuple(r) for r in op._pairs(table, leaders, most).collect()}
        found = dict(enumerate(classes_of(met & near, 60)))
        led = {r["node"] for r in leaders.collect()}
        rest = [(k, i) for k, i in rest if i not in led]
        table = op._unsettled(spark.createDataFrame([(k, i, 1.0, 1.0, 1, found[i]) for k, i in rest], schema))
        most *= 2
    assert found == {i: i - i % 10 for i in range(60)}


def family(n, seed):
    """A text, and copies of it with ever more of its words changed or left out."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10**9)}" for _ in range(120)]
    rows = [" ".join(text)]
    for i in range(n):
        copy = list(text)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            copy[at] = f"x{i}y{at}"
        rows.append(" ".join(copy[: rng.randint(85, 120)]))
    return sorted(set(rows))


def test_a_family_is_compared_by_a_few_pairs_a_member(spark, documents, monkeypatch):
    """Classes are those of all pairs, by a small share of them."""
    counts = {}
    for n in (150, 600):
        texts = family(n, n)
        compared = []
        monkeypatch.setattr(op, "stage", lambda df, name: compared.append(x) or x if (x := staged(df, name)) and name == "checked" else x)
        got, _ = op.near_classes(documents([(i, t, "s") for i, t in enumerate(texts)]))
        found = {r["doc_id"]: r["class_id"] for r in got.collect()}
        near = [pair for pair, similarity in brute(texts).items() if similarity >= op.SIMILARITY]
        expected = dict(enumerate(classes_of(near, len(texts))))
        alike = sum(found[i] == expected[i] for i in found)
        assert alike >= 0.98 * len(texts)
        counts[len(texts)] = sum(x.count() for x in compared)
    assert all(pairs <= 12 * n and pairs <= 0.08 * n * (n - 1) / 2 for n, pairs in counts.items())


staged = op.stage


def test_a_pair_meets_in_one_of_its_buckets(spark):
    bands = {1: [11, 12, 13, 14, 0], 2: [11, 12, 13, 14, 0], 3: [91, 12, 13, 92, 0], 4: [11, 93, 94, 95, 0]}
    nodes = spark.createDataFrame([(i, 1.0, keys) for i, keys in bands.items()], "node long, total double, bands array<long>")
    buckets = op._unsettled(op._buckets(nodes))
    assert buckets.where("node = 1").count() == 6
    leaders = op._leaders(buckets, 8)
    pairs = {tuple(r) for r in op._pairs(buckets, leaders, 8, nodes).collect()}
    assert pairs == {tuple(r) for r in op._pairs(buckets, leaders, 8).collect()} == {(2, 1), (3, 1), (3, 2)}
    keys = [r["key"] for r in buckets.select("key").distinct().collect()]
    met = [op._pairs(buckets.where(F.col("key") == key), leaders, 8, nodes).collect() for key in keys]
    assert sorted(tuple(r) for rows in met for r in rows) == [(2, 1), (3, 1), (3, 2)]


def test_members_carry_their_bands_from_round_to_round(spark):
    """No round looks up the bands of all members and leaders again."""
    bands = {1: [11, 12, 13, 14, 0], 2: [11, 12, 13, 14, 0], 3: [91, 12, 13, 92, 0]}
    nodes = spark.createDataFrame([(i, 1.0, keys) for i, keys in bands.items()], "node long, total double, bands array<long>")
    members = op._unsettled(op._with_bands(op._buckets(nodes), nodes))
    assert "bands" in members.columns and "bands" in op._leaders(members, 8).columns
    pairs = op._pairs(members, op._leaders(members, 8), 8)
    assert {tuple(r) for r in pairs.collect()} == {(2, 1), (3, 1), (3, 2)}
    left = op._unsettled(members.select(*op._carried(members), F.lit(1).alias("class")))
    assert "bands" in left.columns and left.isEmpty()


def test_parts_bound_what_two_texts_have_in_common(spark):
    rng = np.random.default_rng(7)
    universe, weight = rng.integers(1, 2**62, 400, dtype=np.uint64), rng.uniform(0.1, 9, 400)
    weight[0] = 1 / 3
    sides = [np.sort(rng.choice(400, 300, replace=False)) for _ in range(30)]
    owner, picked = np.repeat(np.arange(30), 300), np.concatenate(sides)
    sums = op.parts_of(owner, universe[picked], weight[picked], 30).reshape(30, op.PARTS)
    total = [weight[side].sum() for side in sides]
    rows = [(a, b, float(total[a]), sums[a].tolist(), float(total[b]), sums[b].tolist()) for a in range(30) for b in range(a)]
    table = spark.createDataFrame(rows, "a long, b long, total double, parts array<float>, other_total double, other_parts array<float>")
    alike = op._alike(F.col("total"), F.col("parts"), F.col("other_total"), F.col("other_parts"))
    kept = {(r["a"], r["b"]): r["alike"] for r in table.select("a", "b", alike.alias("alike")).collect()}
    for (a, b), may in kept.items():
        common = weight[np.intersect1d(sides[a], sides[b])].sum()
        assert np.minimum(sums[a].astype(float), sums[b]).sum() >= common
        assert may or common < op.SIMILARITY * (total[a] + total[b] - common)
    assert not all(kept.values())
    # A text is always as similar to itself as need be, whatever rounding does.
    assert (sums.astype(float).sum(axis=1) >= total).all()


def test_unlike_copies_of_one_text_are_ruled_out_unread(spark, documents, monkeypatch):
    """Candidates of large buckets, each as near to a text that is not there as copies are."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    texts = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(0, 200, 5), 3):
            copy[at] = f"x{i}y{at}"
        texts.append(" ".join(copy))
    compared = []
    monkeypatch.setattr(op, "stage", lambda df, name: compared.append(x) or x if (x := staged(df, name)) and name == "checked" else x)
    got, _ = op.near_classes(documents([(i, t, "s") for i, t in enumerate(texts)]))
    near = [pair for pair, similarity in brute(texts).items() if similarity >= op.SIMILARITY]
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == dict(enumerate(classes_of(near, 60)))
    assert sum(x.count() for x in compared) <= 6 * 60
