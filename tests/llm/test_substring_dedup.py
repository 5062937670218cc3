from __future__ import annotations

import random
import re

import pytest

from affinity.llm import substring_dedup
from affinity.llm.substring_dedup import remove_repeats


def brute(rows, window):
    """(n_words, n_removed, kept) by row, in the order of (doc_id, text), null first."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for start in range(len(words) - window + 1):
            run = tuple(words[start : start + window])
            if run in seen:
                gone[start : start + window] = [True] * window
            seen.add(run)
        out.append((doc_id, text, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefg") + str(rng.randrange(40)) for _ in range(n)) for n in (6, 9, 30)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice("abcdefg") + str(rng.randrange(40)) for _ in range(rng.randrange(12)))]
        parts += rng.choices(shared, k=rng.randrange(3))
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts), "s"))
    return rows


@pytest.mark.parametrize("window, group_size", [(5, 1_000_000), (5, 25), (4, 3), (1, 5)])
def test_equals_brute_force(spark, documents, window, group_size):
    rows = passages(window)
    got = remove_repeats(documents(rows), window, group_size).select(
        "row.doc_id", "row.text", "n_words", "n_removed", "kept"
    )
    assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:2] for r in rows], window)


def test_chunks_in_any_number(spark, documents, monkeypatch):
    rows = passages(9)
    monkeypatch.setattr(substring_dedup.chunked, "__defaults__", (300,))
    got = remove_repeats(documents(rows), 5, 20).select("row.doc_id", "row.text", "n_words", "n_removed", "kept")
    assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:2] for r in rows], 5)


def test_odd_rows(spark, documents, odd_rows):
    got = remove_repeats(documents(odd_rows), 3).select("row.doc_id", "row.text", "n_words", "n_removed", "kept")
    assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:2] for r in odd_rows], 3)


def test_repeats_are_maximal_runs(spark, documents):
    rows = [(1, "a b c d e f", "s"), (2, "x b c d e y b c d", "s")]
    got = {r["doc_id"]: r["repeats"] for r in remove_repeats(documents(rows), 3).select("row.doc_id", "repeats").collect()}
    assert got == {1: [], 2: [[1, 5], [6, 9]]}


def test_empty_table(spark, documents):
    assert remove_repeats(documents([])).count() == 0
