"""Columns of the registered queries, and the one that has SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracle import connect, difference

from affinity.llm.queries import MODULES

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
COLUMNS = {
    "op2": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3": ["page_id", "url", "text", "n_chars"],
    "op4": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8": ["doc_id", "held_out", "score", "predicted"],
    "op9": ["doc_id", "size", "source_size", "target", "taken"],
    "op11": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op12": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op13": ["word", "form", "root", "n", "n_near", "form_n"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, SF_DIR)
    table = "pages" if name.split("_")[0] in ("op3", "op10") else "documents"
    got = rows.toPandas()
    if not name.startswith("op13_"):
        assert len(got) == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    expected = COLUMNS.get(name.split("_")[0])
    assert expected is None or rows.columns == expected
    if name in ORACLES:
        assert difference(got, connect(SF_DIR).execute(ORACLES[name]).df()) is None
