"""The tree, its proofs and the audit against a plain version in Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from affinity.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def beside(tree, at):
    path = []
    for level in tree[:-1]:
        other = at ^ 1
        path.append((at & 1, level[other] if other < len(level) else None))
        at //= 2
    return path


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault("" if row[2] is None else "=" + row[2], []).append(row)
    trees = {}
    for name, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = levels([leaf(r) for r in members])
    names = sorted(trees, key=lambda n: n.encode())
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for name, members in groups.items():
        for at, row in enumerate(members):
            path = beside(trees[name], at) + beside(top, names.index(name))
            hit = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, int(hit))
            for left, other in path:
                node = sha(node) if other is None else sha(other, node) if left else sha(node, other)
            proof = sha(*[other for _, other in path if other is not None])
            out.append((row[0], leaf(row), trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def audited(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({name: F.lit(7) for name in ("group", "pos", "n", "digest", "levels", "key", "root", "path", "shown")})
    return sorted(map(tuple, merkle.audit(df).collect()), key=repr)


ODD = [
    (None, "s", "en", 3, "null id"), (None, "s", "en", 3, "null id"), (1, None, None, None, None), (2, "s", "", 0, ""),
    (3, "s", "-", 5, "dash"), (4, "s", "en", 4, "same"), (4, "s", "en", 4, "same"), (4, "s", "en", 4, "other"),
    (5, "é", "ß", 9, "é ß 中文 😀"), (6, "s", "en", 10, "long " * 50_000), (7, "s", None, 1, "x"), (8, "s", "=", 1, "y"),
]


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_odd_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "WIDTH", 1 << bits)
    assert audited(spark, ODD) == sorted(plain(ODD), key=repr)


@pytest.mark.parametrize("rows", [[], ODD[4:5], ODD[4:6], [(i, "s", "en", 1, "t") for i in range(17)]], ids=["empty", "one", "two", "one lang"])
def test_small_tables(spark, monkeypatch, rows):
    monkeypatch.setattr(merkle, "BITS", 2)
    monkeypatch.setattr(merkle, "WIDTH", 4)
    assert audited(spark, rows) == sorted(plain(rows), key=repr)


def test_many_groups_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", 2)
    monkeypatch.setattr(merkle, "WIDTH", 4)
    sizes = [1, 2, 3, 4, 5, 8, 16, 17, 33, 64, 65]
    rows = [(i, f"s{i % 3}", f"l{g:02d}", i, f"text {i}") for g, size in enumerate(sizes) for i in range(size)]
    got = audited(spark, rows)
    assert got == sorted(plain(rows), key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_requests_for_some_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", 1)
    monkeypatch.setattr(merkle, "WIDTH", 2)
    rows = [(i, "s", "ab"[i % 2], 1, f"t{i}") for i in range(40)]
    manifest = merkle.build(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)))
    asked = spark.createDataFrame(
        [("=a", 3, "x"), ("=b", 19, "y"), ("=b", 19, "z"), ("=b", 20, "none"), ("=c", 0, "none")], "group string, pos long, tag string"
    ).withColumn("shown", F.lit("0" * 64))
    proved = merkle.prove(manifest, asked).collect()
    assert sorted(r["tag"] for r in proved) == ["x", "y", "z"]
    expected = {r[0]: r for r in plain(rows)}
    for r in proved:
        doc_id = 6 if r["tag"] == "x" else 39
        assert sha(*[b["digest"] for b in r["path"] if b["digest"]]) == expected[doc_id][4]
        assert r["subroot"] == expected[doc_id][2] and r["folded_root"] != r["root"]


def test_equal_subtrees_share_a_record(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BITS", 1)
    monkeypatch.setattr(merkle, "WIDTH", 2)
    rows = [(1, "s", "en", 1, "same")] * 16
    manifest = merkle.build(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)))
    assert manifest.store.count() == 4
    assert audited(spark, rows) == sorted(plain(rows), key=repr)
