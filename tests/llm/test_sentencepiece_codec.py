from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest

from affinity.llm import sentencepiece_codec as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no vocabulary here")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(sp.Vocabulary(sp.MODEL))


def texts(seed):
    rng = random.Random(seed)
    alphabet = "abcdefghijklmnopqrstuvwxyzéèABC,.!0123 \n\t▁"
    stems = "international understand university the of and relationship something".split()
    out = ["", " ", "  Hello  world\n\tab c 　x é 😀 ", "中文字符測試 日本語", "x" * 300, "\n\n", "    in\n  more"]
    out += ["".join(rng.choices(alphabet, k=rng.randrange(1, 80))) for _ in range(400)]
    out += ["".join(rng.choice(stems)[: rng.randrange(1, 12)] for _ in range(8)) for _ in range(400)]
    return out


def test_ids_equal_the_library(codec, library):
    for part in (texts(1), texts(2)):
        ids, counts = codec.encode(pa.array(part))
        at = 0
        for text, n in zip(part, counts):
            assert ids[at : at + n].tolist() == library.encode(text), repr(text)
            at += n
        assert codec.decode(ids, counts) == [library.decode(library.encode(t)) for t in part]


def test_table(spark, documents, odd_rows, library):
    tokens = sp.encode(documents(odd_rows))
    got = tokens.select("row.doc_id", "row.text", "row.key", "ids", "round_trip").collect()
    assert len(got) == len(odd_rows)
    for row in got:
        assert row["ids"] == library.encode(row["text"] or "") and row["round_trip"] and row["key"] == "x"
    back = sp.decode(tokens.select("row.doc_id", "row.text", "ids").withColumnRenamed("text", "was"))
    assert all(r["was"] in (r["text"], None) for r in back.select("row.was", "text").collect())
    assert sp.encode(documents([])).count() == 0
