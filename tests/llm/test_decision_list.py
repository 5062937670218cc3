from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from affinity.llm import decision_list as op

LABELS = "doc_id long, quality int"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def odd_texts():
    rng = random.Random(6)
    texts = ["#a *b\n\n \n#a *b\n#a *b", "x " * 40, "a b c d e f g h", "|" * 9, "é\x0bß\x0c中 😀<>"]
    for _ in range(40):
        words = rng.choices("abc", k=rng.randrange(60))
        texts.append("".join(w + rng.choice(" \n\t") for w in words))
    return texts


def statistics(spark, documents, rows):
    docs = documents(rows)
    return op.statistics(docs.select(F.struct("doc_id", "text").alias("row"), "text"))


def test_base_counts_equal_brute_force(spark, documents, odd_rows):
    rows = odd_rows + [(100 + i, t, "s") for i, t in enumerate(odd_texts())]
    got = statistics(spark, documents, rows).select("row.text", *COUNTS, "base_failed").collect()
    assert len(got) == len(rows)
    for row in got:
        expected = brute(row["text"])
        assert tuple(row[c] for c in COUNTS) == expected, repr(row["text"])
        assert row["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])


def corpus(n=300):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(40, 120))]
        kind = rng.choice(["good", "good", "symbols", "upper"])
        words = [w + "#" for w in words] if kind == "symbols" else [w.upper() + "!" for w in words] if kind == "upper" else words
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(kind == "good")))
    return rows, labels


def test_learned_rules_reject_the_bad(spark, documents):
    rows, labels = corpus()
    got = op.judged(documents(rows), spark.createDataFrame(labels, LABELS)).select("row.doc_id", "kept").collect()
    wrong = [r["doc_id"] for r in got if r["kept"] != bool(labels[r["doc_id"]][1])]
    assert len(got) == len(rows) and len(wrong) <= 3


def test_rules_are_read_in_order():
    rules = [(op.Test("n_words", False, 1, 20.0),), (op.Test("word_length", True, 1, 9.0), op.Test("n_words", True, 1, 50.0))]
    text = op.verdict(rules)._jc.toString()
    assert text.index("n_words") < text.index("word_length")


def test_no_labels_and_no_rows(spark, documents, odd_rows):
    none = spark.createDataFrame([(None, 1), (1, None), (2, 5)], LABELS)
    got = op.judged(documents(odd_rows), none)
    assert all(r["kept"] == (not r["base_failed"]) for r in got.collect())
    assert op.judged(documents([]), none).count() == 0


def test_main_path_has_no_python(spark, documents):
    rows, labels = corpus(60)
    plan = op.judged(documents(rows), spark.createDataFrame(labels, LABELS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("bad, good", [(0, 10), (2, 2)])
def test_too_few_bad_rows_give_no_rule(spark, documents, bad, good):
    rows, labels = corpus(bad + good)
    labels = [(i, int(i >= bad)) for i, _ in labels]
    table = statistics(spark, documents, rows).select(F.col("row.doc_id").alias("doc_id"), *op.STATISTICS)
    assert op.learn(table.join(spark.createDataFrame(labels, LABELS), "doc_id")) == []
