"""Article embeddings from word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.functions.sums import exact_sum


def article_embedding(terms: DataFrame) -> DataFrame:
    """Element-wise mean of the word vectors of each article.

    Slots are summed map-side, so an article with very many terms sends one row a slot and
    task. The sums are exact, so the mean does not depend on how the terms are dealt.
    """
    slots = terms.select("article_id", F.posexplode("vector").alias("slot", "value"))
    means = slots.groupBy("article_id", "slot").agg((exact_sum(F.col("value")) / F.count("value")).alias("mean"))
    held = means.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("slot", "mean"))).alias("held"))
    return held.select("article_id", F.col("held.mean").alias("article_vector"))
