from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from affinity.llm import url_filters as op

CAPTURES = "url string, fetched date, n int"
ENTRIES = "pattern string, action string, day date"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def host(url):
    if not url or "://" not in url:
        return None
    return url.split("://", 1)[1].split("/")[0].split("?")[0].split("@")[-1].split(":")[0].lower() or None


def brute(captures, entries):
    rank = ["allow", "block", "remove"]
    known = {}
    for pattern, action, when in entries:
        if pattern and action and when:
            old = known.setdefault(pattern, {})
            old[when] = min(old.get(when, "remove"), action, key=rank.index)
    out = []
    for url, fetched, n in captures:
        name, best = host(url), None
        labels = name.split(".") if name and fetched else []
        for i in range(len(labels)):
            entry = max(((d, a) for d, a in known.get(".".join(labels[i:]), {}).items() if d <= fetched), default=None)
            if entry and entry[1] != "remove":
                best = (entry[1] == "block", ".".join(labels[i:]), entry[0])
                break
        out.append((url, fetched, n, *(best or (False, None, None))))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(7)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "www.b.org", "c.net"]
    entries = [(rng.choice(hosts), rng.choice(["block", "allow", "remove"]), day(rng.randrange(60))) for _ in range(60)]
    entries += [(None, "block", day(1)), ("a.com", None, day(2)), ("a.com", "block", None)]
    captures = [(f"https://u@{rng.choice(hosts).upper()}:80/p?{i}", day(rng.randrange(-5, 70)), i) for i in range(300)]
    captures += [(None, day(3), 1), ("nonsense", day(3), 2), ("http://a.com", None, 3), ("http:///x", day(9), 4)]
    captures += captures[:5]
    df = spark.createDataFrame(captures, CAPTURES)
    got = op.judge(df, spark.createDataFrame(entries, ENTRIES))
    assert got.columns == ["url", "fetched", "n", "blocked", "pattern", "listed"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(captures, entries)


def test_clashing_columns_and_empty_tables(spark):
    names = ("host", "pattern", "blocked", "listed", "since", "own", "day", "row")
    captures = spark.createDataFrame([("http://a.com/", day(5), 1)], CAPTURES).withColumns({c: F.lit(1) for c in names})
    entries = spark.createDataFrame([("a.com", "block", day(5))], ENTRIES)
    row = op.judge(captures, entries).first()
    assert row["blocked"] is True and row["pattern"] == "a.com" and row["host"] == 1
    assert op.judge(captures, entries.limit(0)).first()["blocked"] is False
    assert op.judge(captures.limit(0), entries).count() == 0


def test_main_path_has_no_python(spark):
    captures = spark.createDataFrame([("http://a.com/", day(5), 1)], CAPTURES)
    entries = spark.createDataFrame([("a.com", "block", day(5))], ENTRIES)
    plan = op.judge(captures, entries)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
