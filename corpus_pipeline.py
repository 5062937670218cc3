"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm import gam_quality, icws_dedup, mixing, sentencepiece_codec, substring_dedup
from affinity.llm.common import read, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model predicts good, as they were."""
    return gam_quality.keep_good(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least doc_id."""
    return icws_dedup.keep_one(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; a document keeps its text as it was
    if it has none, and goes if no word of it is left."""
    cut = substring_dedup.remove_repeats(docs).filter("n_words = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast("long")}
    return cut.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated or in part as the sources' targets ask."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of every document with its token ids."""
    return sentencepiece_codec.encode(docs).select(
        "row.doc_id", "row.lang", "row.source", F.size("ids").alias("n_tokens"), "ids", "round_trip"
    )


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_dedup),
    ("substring dedup", substring),
    ("mixing sources", mix),
    ("token ids", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
