from __future__ import annotations

import re

from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from affinity.llm import gam_quality, icws_dedup, mixing, sentencepiece_codec, substring_dedup

SF_DIR = "/root/testdata/sf0.001"


def test_stages_call_the_operators_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    columns = docs.columns
    steps = []
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        steps.append((docs, after))
        docs = after
    assert all(after.columns == columns for _, after in steps[:-1])

    (before, good), (_, single), (_, cut), (_, mixed), (_, ids) = steps
    model = gam_quality.train(gam_quality.with_features(before, "doc_id"), labels.select("doc_id", "quality"))
    scores = gam_quality.scored(gam_quality.with_features(before, "doc_id"), model)
    expected = {r["doc_id"] for r in scores.filter("predicted = 1").select("row.doc_id").collect()}
    assert {r["doc_id"] for r in good.collect()} == expected
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = [known[i] for i in expected if i in known]
    assert sum(kept) == sum(known.values()) and len(kept) < len(known)

    classes = icws_dedup.near_classes(good)[0].collect()
    assert {r["doc_id"] for r in single.collect()} == {r["class_id"] for r in classes}

    removed = substring_dedup.remove_repeats(single).select("row.doc_id", "n_removed", "kept", "row.text").collect()
    texts = {r["doc_id"]: r["kept"] if r["n_removed"] else r["text"] for r in removed}
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got == {i: t for i, t in texts.items() if t}

    taken = {r["doc_id"]: r["taken"] for r in mixing.allocate(cut).collect() if r["taken"]}
    held = mixed.groupBy("doc_id").agg(F.sum(F.size(mixing.words(F.col("text")))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in held} == taken

    assert ids.count() == mixed.count() and ids.filter("not round_trip").count() == 0
    one = sentencepiece_codec.encode(mixed.limit(5)).select("row.text", "ids").collect()
    assert all(len(r["ids"]) >= len(re.findall(r"\S+", r["text"])) for r in one)


def test_registered_queries():
    names = contract.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    assert rows.count() > 0
