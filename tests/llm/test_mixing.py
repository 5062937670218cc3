from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from affinity.llm import mixing as op


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "Z", "é", None, "big"]
    rows = []
    for i in range(n):
        source = "big" if rng.random() < 0.4 else rng.choice(sources)
        rows.append((i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 200))), source))
    return rows


def shared(sizes):
    """Targets by dealing the excess again until none is left."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("shard_words", [1 << 20, 900])
def test_targets_and_takes(spark, documents, shard_words):
    rows = corpus()
    got = op.allocate(documents(rows), block=16, shard_words=shard_words).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, source in rows:
        sizes[source] += n_words(text)
    expected = shared(sizes)
    for r in got:
        assert r["size"] == n_words(rows[r["doc_id"]][1]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["passes"] * r["size"] + sum(p["to"] - p["from"] for p in r["parts"])
        assert all(0 <= p["from"] < p["to"] <= r["size"] for p in r["parts"])
        taken[r["source"]] += r["taken"]
    shards = 1 + max(sizes.values()) / shard_words
    assert all(abs(taken[s] - expected[s]) <= 16 * (2 + shards) for s in sizes)
    again = op.allocate(documents(rows), block=16, shard_words=shard_words).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_equals_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for g in range(4):
        weights = [rng.choice([0, 1, 1, 5, 300 * rng.random()]) for _ in range(rng.randrange(1, 25))]
        quota, total = rng.randrange(0, 150), float(sum(weights))
        seats = [0] * len(weights)
        for _ in range(quota if total else 0):
            best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * seats[i] + 1), -i))
            seats[best] += 1
        expected |= {(g, i): n for i, n in enumerate(seats)}
        rows += [(g, i, float(w), total, quota) for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "g int, i int, w double, t double, q long")
    got = op.apportion(df, ["g"], F.col("i"), "w", "t", "q").collect()
    assert {(r["g"], r["i"]): r["seats"] for r in got} == expected


def test_mixed_documents_hold_what_is_taken(spark, documents):
    rows = corpus(5, 80)
    docs = documents(rows)
    plan = {r["doc_id"]: r["taken"] for r in op.allocate(docs).collect()}
    mixed = op.mix_documents(docs)
    assert mixed.columns == docs.columns
    held = defaultdict(int)
    for r in mixed.collect():
        held[r["doc_id"]] += n_words(r["text"])
        assert r["n_chars"] == len(r["text"])
        part, whole = r["text"].split(), rows[r["doc_id"]][1].split()
        assert any(whole[i : i + 1] == part[:1] for i in range(len(whole)))
    assert held == {i: n for i, n in plan.items() if n}


def test_odd_rows(spark, documents, odd_rows):
    got = op.allocate(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert op.mix_documents(documents(odd_rows)).columns == documents(odd_rows).columns
    assert op.allocate(documents([])).count() == 0 and op.mix_documents(documents([])).count() == 0
    blank = [(1, "", "a"), (2, None, "b")]
    assert [r["taken"] for r in op.allocate(documents(blank)).collect()] == [0, 0]
