"""Known forms against Python's own patterns, the battery against simulation and planted tokens."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from affinity.llm import secret_scan

SF_DIR = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def base64ish(rng, n):
    return "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))


def test_known_forms(spark, documents, odd_rows):
    rng = random.Random(1)
    parts = [
        "token=", "TOKEN : '", 'api_key" = "', "ApiKey:", "passwd=secret=", "token=api_key: abcdefghijklmnop", "ſecret=abcdefghijklmnop",
        "Kelvin toKen=aaaaaaaaaaaaaaa", "AKIA", "AKIAAKIA", "AKIA" + "Q7" * 7, "XAKIA" + "B" * 20 + "x", "0123456789abcdef", "deadbeef" * 5 + "g",
        "é😀", " ", "\n", "\x0b", "..==", "word", "'", '"', "abcdefghijkl", "0" * 15, "f" * 16,
    ]
    rows = odd_rows + [(i, "".join(rng.choices(parts, k=30)), "s1") for i in range(20, 120)]
    rows += [(200, "x " * 400_000 + "token = 0123456789abcdef" + " é" * 50, "s2"), (201, "0123456789abcdef0 " * 1500, "s2")]
    got = secret_scan.scan(documents(rows)).select("row.doc_id", "known").collect()
    held = sorted((repr(r["doc_id"]), [tuple(s) for s in r["known"]]) for r in got)
    assert held == sorted((repr(i), plain(t)) for i, t, _ in rows)


def test_added_spans(spark, documents):
    """Random tokens are found where they stand, ordinary long ones are not."""
    rng = random.Random(2)
    texts = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()]
    ordinary = [
        "src/main/python/package/module_name", "Diebundesregierungen", "4111111111111111", "2024-01-31T12-00-00", "aaaaaaaaBBBBBBBB1111",
        "abcdefghijklmnopqrstuvwxyz0123456789", "ThisIsACamelCaseIdentifierName", "UPPERCASEHEADLINEWORD", "version2024finalreport",
    ]
    rows, planted = [], {}
    for i, text in enumerate(texts):
        words = text.split(" ")
        if i % 3 == 0:
            secret = base64ish(rng, rng.choice([24, 32, 40, 64]))
            at = rng.randrange(len(words) + 1)
            words.insert(at, secret)
            planted[i] = secret
        words.append(ordinary[i % len(ordinary)])
        rows.append((i, " ".join(words), "s1"))
    got = secret_scan.scan(documents(rows)).select("row.doc_id", "added").collect()
    found = {r["doc_id"]: [rows[r["doc_id"]][1][s["start"] : s["end"]] for s in r["added"]] for r in got if r["added"]}
    hits = [i for i, s in planted.items() if s in found.get(i, [])]
    assert len(hits) >= 0.9 * len(planted)
    extra = [s for i, spans in found.items() for s in spans if s != planted.get(i)]
    assert len(extra) <= 0.02 * len(hits), extra


@pytest.mark.parametrize("encoding,n", [("hex", 20), ("base64", 24), ("base64", 60), ("base36", 33)])
def test_p_values_of_random_tokens(spark, encoding, n):
    """Of uniform random tokens a share of about alpha has a p-value below alpha."""
    rng = random.Random(n)
    alphabet = secret_scan.ALPHABETS[encoding]
    tokens = []
    while len(tokens) < 2000:
        token = "".join(rng.choice(alphabet) for _ in range(n))
        if re.search("[0-9]", token) and re.search("[g-z]" if encoding == "base36" else "[a-f]", token) and (encoding != "base64" or re.search("[A-Z]", token)):
            tokens.append((token,))
    items = F.array(F.struct(F.lit(0).alias("start"), F.lit(n).alias("end"), F.col("text")))
    df = spark.createDataFrame(tokens, "text string").select(F.inline(secret_scan.tested(items, secret_scan.laws({}))))
    rows = df.collect()
    assert {r["encoding"] for r in rows} == {encoding}
    for alpha in (0.05, 0.2, 0.5):
        assert abs(sum(r["p_random"] <= alpha for r in rows) / len(rows) - alpha) < 0.3 * alpha + 0.03
    assert sum(r["p_random"] < secret_scan.LEAST_RANDOM for r in rows) <= 0.035 * len(rows)


def test_normal_law(spark):
    zs = [x / 10 for x in range(-80, 81)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", secret_scan.below(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), abs=1e-7, rel=2e-2 if abs(r["z"]) > 5 else 1e-3)


def test_discoveries_follow_benjamini_hochberg(spark):
    rng = random.Random(4)
    rows = [("hex", 10 ** -rng.uniform(0, 6), rng.choice([0.0, 0.5, 0.9])) for _ in range(3000)] + [("letters", rng.random(), 1.0) for _ in range(500)]
    got = secret_scan.thresholds(spark.createDataFrame(rows, "encoding string, p_text double, p_random double").withColumn("token", F.xxhash64("p_text")))
    expected = {}
    for name in ("hex", "letters"):
        p = [t if r >= secret_scan.LEAST_RANDOM else 1.0 for e, t, r in rows if e == name]
        bins = [min(math.floor(-math.log10(x) * 100), 1500) for x in p]
        good = [b for b in set(bins) if 10 ** (-b / 100) <= secret_scan.FALSE_SHARE * sum(c >= b for c in bins) / len(p)]
        if good:
            expected[name] = min(good)
    assert got == expected and "hex" in got and "letters" not in got


def test_query_digest_and_empty_table(spark, documents):
    rows = [(1, "token=abcdefghijklmnop and 0123456789abcdef", "s")]
    documents(rows).write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/secrets/documents.parquet")
    got = secret_scan.op12_secret_scan(spark, path.rsplit("/", 1)[0]).collect()
    assert [tuple(r)[:4] for r in got] == [(1, 1, 0, 1)]
    assert got[0]["base_sha256"] == hashlib.sha256(b"assign:0:22,hex:27:43").hexdigest() and got[0]["spans"] == "assign:0:22,hex:27:43"
    assert secret_scan.scan(documents([]).filter("false")).collect() == []
