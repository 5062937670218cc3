"""Neighbours, forms and roots against all pairs in Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from affinity.llm import permuterm


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if one_apart(word, w)]
        best = min(near, key=lambda w: (-counts[w], [ord(c) for c in w]), default=None)
        form = best if best and counts[best] >= 2 * n else None
        out[word] = [form, n, len(near), counts[form] if form else None]
    for word, row in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        row.append(root)
    return {word: tuple(row) for word, row in out.items()}


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 97 else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def grouped(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    rows = permuterm.group_variants(words).collect()
    assert len(rows) == len(counts)
    return {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in rows}


def test_random_words(spark):
    rng = random.Random(5)
    counts = {}
    for _ in range(900):
        word = "".join(rng.choice("aab") for _ in range(rng.randint(5, 9)))
        counts[word] = rng.choice([3, 3, 4, 6, 7, 12, 25, 60])
    counts |= {"écoles": 9, "ecoles": 4, "écolés": 4, "éécoles": 3, "zzzzz": 3, "aaaaa": 100, "aaaaaa": 30, "aaaaaaa": 12}
    assert grouped(spark, counts) == plain(counts)


def test_long_chain_of_forms(spark):
    base = "abcdefghijkl"
    counts = {base[:i] + "z" * (12 - i): 3 * 2**i for i in range(13)}
    got = grouped(spark, counts)
    assert got == plain(counts)
    assert {row[4] for row in got.values()} == {base}


def test_full_group(spark):
    """All letters at one place: one group, each member sees all others."""
    counts = {f"word{chr(c)}": 5 for c in range(0xC0, 0x100)} | {"words": 50, "word": 100}
    got = grouped(spark, counts)
    assert got == plain(counts)
    assert got["wordé"][2] == len(counts) - 1


def test_documents(spark, documents, odd_rows):
    rng = random.Random(3)
    words = ["Schönheit", "hello", "helo", "Écoles", "écoles", "TABLE", "tables", "aaaaaa", "÷÷÷÷÷÷", "x", "don't", "ﬁnes"]
    rows = odd_rows + [(i, " ".join(rng.choices(words, k=60)), "s1") for i in range(20, 90)]
    rows += [(200, "very " + "long hello9tables_" * 20_000, "s2"), (20, rows[10][1], "s1")]
    docs = documents(rows)
    counts = {r["word"]: r["n"] for r in permuterm.word_counts(docs).collect()}
    assert counts == plain_counts([(i, t) for i, t, _ in rows])
    assert any(w not in " ".join(t or "" for _, t, _ in rows).lower() for w in counts), "an edited word is often enough"


def test_no_words(spark, documents):
    empty = documents([]).filter("false")
    assert permuterm.group_variants(permuterm.word_counts(empty)).collect() == []
