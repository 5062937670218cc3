from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from affinity.llm import syncmers


@pytest.mark.parametrize("chunk_bytes", [4 << 20, 60])
def test_edited_texts_and_neighbours(spark, documents, odd_rows, monkeypatch, chunk_bytes):
    monkeypatch.setattr(syncmers.chunked, "__defaults__", (chunk_bytes,))
    got = syncmers.compare_neighbours(documents(odd_rows)).select("row.doc_id", "row.text", *syncmers._FIELDS).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    plain = [t or "" for _, t, _ in order]
    expected = []
    for i, text in enumerate(plain):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + plain[i - 1][:cut]
        expected.append((order[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(repr, expected)) == sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)
    prints = {}
    for row in got:
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        assert prints.setdefault(row["text"], row["fingerprint"]) == row["fingerprint"]


def test_anchors_are_closed_syncmers():
    text = bytes((i * i * 7 + i // 3) % 251 for i in range(400))
    order = lambda run: int(syncmers.mix(syncmers.np.array([int.from_bytes(run, "big")], syncmers.np.uint64))[0])
    expected = []
    for at in range(len(text) - syncmers.K + 1):
        inner = [order(text[at + i : at + i + syncmers.S]) for i in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            expected.append(at)
    data = syncmers.np.frombuffer(text + b"\0" * syncmers.K, syncmers.np.uint8)
    places, _ = syncmers._anchors(data)
    assert [p for p in places.tolist() if p + syncmers.K <= len(text)] == expected


def alike(*texts):
    prints = syncmers.fingerprints([t.encode() for t in texts])
    return float(syncmers.likeness(prints.rows(0, 1), prints.rows(1, 2))[0])


def brute_force(a, b):
    """Likeness by the definition, with counters of links."""
    links = []
    for text in (a.encode(), b.encode()):
        prints = syncmers.fingerprints([text])
        anchors = list(zip(prints.hashes.tolist(), prints.places.tolist()))
        pairs = [(h, k, q - p) for (h, p), (k, q) in zip(anchors, anchors[1:])]
        links.append(Counter(pairs or anchors[:1]))
    total = sum(links[0].values()) + sum(links[1].values())
    return 2 * sum((links[0] & links[1]).values()) / total if total else 1.0


def test_likeness_follows_its_definition(odd_rows):
    texts = [t or "" for _, t, _ in odd_rows] + ["ab" * 3000, "ab" * 200 + "xy" * 9, "abcdefghijklmnopqr", "0123456789abcdef"]
    pairs = [(a, b) for a in texts for b in texts]
    sides = [syncmers.fingerprints([pair[i].encode() for pair in pairs]) for i in (0, 1)]
    assert syncmers.likeness(*sides).tolist() == pytest.approx([brute_force(*pair) for pair in pairs])
    again = [syncmers.from_text(syncmers.text_form(side)) for side in sides]
    for side, other in zip(sides, again):
        assert all((x == y).all() for x, y in zip(side, other))


def test_many_pairs_at_once():
    texts = [f"text {i * i} of many " * (i % 5) for i in range(3000)]
    a, b = (syncmers.fingerprints([t.encode() for t in x]) for x in (texts, texts[::-1]))
    got = syncmers.likeness(a, b)
    assert got.tolist() == pytest.approx([brute_force(*pair) for pair in zip(texts, texts[::-1])])


def test_distances_fit_a_byte():
    rng = syncmers.np.random.default_rng(3)
    texts = [rng.integers(0, kinds, 5000).astype("u1").tobytes() for kinds in (1, 2, 4, 256)]
    prints = syncmers.fingerprints(texts)
    for i in range(len(texts)):
        places = prints.rows(i, i + 1).places
        assert syncmers.np.diff(places, prepend=0).max() <= syncmers.K - syncmers.S


def test_likeness_of_edits():
    words = [f"word{i * i % 9973}x{i}" for i in range(20000)]
    other = [f"term{i * 31 % 7919}y{i}" for i in range(20000)]
    text = " ".join(words)
    added = " ".join([*words[:10000], *(f"new{i}" for i in range(15)), *words[10000:]])
    assert alike(text, text) == 1
    assert alike(text, added) > 0.99
    assert alike(text, " ".join([*words[:1000], *other[1000:]])) == pytest.approx(0.05, abs=0.01)
    assert alike(text, " ".join([*words[-4000:], *other[4000:]])) == pytest.approx(0.2, abs=0.02)
    assert alike(text, " ".join(words[10000:] + words[:10000])) > 0.99
    assert alike(text, " ".join(other)) < 0.02
    assert alike("", "") == 1 and alike("", "ab") == 0 and alike("ab", "ab") == 1 and alike("ab", "ac") == 0


def test_empty_table_and_single_row(spark, documents):
    assert syncmers.compare_neighbours(documents([])).count() == 0
    row = syncmers.compare_neighbours(documents([(1, "abcdef", "s")])).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
