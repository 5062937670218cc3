"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix has 150 % of all words. Sources share it by weight; no target passes twice its
source's words, and the excess goes to the others by weight. The mix is dealt in blocks of
BLOCK words: sources get whole numbers of blocks by highest quotients (target / 1, / 3,
/ 5, ...). A source is taken whole as often as its target holds it; the blocks left over are
dealt to its shards, again by highest quotients of their words. A shard is a part of a
source by hash of doc_id; its documents follow one another in seeded order, are cut into
blocks, and the blocks with the least seeded hashes fill its quota.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.llm.common import read, stage, words

BLOCK = 64
SHARD_WORDS = 1 << 20
MOST_SHARDS = 100_000
SHARE = 1.5
WEIGHTS = (3, 1, 2)
SEED = 17


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with ``target`` and ``total``, the words of the mix.

    One row a source. The sources that stop at twice their size are those with the least
    size for their weight; they are found by running sums in that order.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("weight", weight)
        .withColumn("most", 2 * F.col("source_size"))
        .withColumn("total", SHARE * F.sum("source_size").over(everything))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("level") * F.col("weight"), F.col("most").cast("double")))
        .select("source", "source_size", "target", "total")
    )


def apportion(rows: DataFrame, group: list[str], name: Column, weight: str, total: str, quota: str) -> DataFrame:
    """``rows`` with ``seats``: ``quota`` seats of each group by highest quotients of ``weight``.

    ``total`` is the group's sum of weights. With K rows and Q seats, a row's seats differ
    from its share q by less than 2 + q K / Q, so only quotients that near are compared, about
    five for each row.
    """
    within = Window.partitionBy(*group)
    share = F.when(F.col(total) > 0, F.col(quota) * F.col(weight) / F.col(total)).otherwise(F.lit(0.0))
    reach = F.lit(2) + F.ceil(F.col("_share") * F.count("*").over(within) / F.greatest(F.col(quota), F.lit(1)))
    columns = rows.columns
    based = (
        rows.withColumn("_name", name)
        .withColumn("_share", share)
        .withColumn("_reach", reach)
        .withColumn("_base", F.greatest(F.lit(0), F.floor(F.col("_share")) - F.col("_reach")))
        .withColumn("_open", F.col(quota) - F.sum("_base").over(within))
    )
    nth = F.explode(F.sequence(F.col("_base"), F.col("_base") + 2 * F.col("_reach") + 1))
    quotient = F.col(weight) / (2 * F.col("_nth") + 1)
    first = Window.partitionBy(*group).orderBy(F.col("_quotient").desc(), "_name", "_nth")
    seats = (
        based.withColumn("_nth", nth)
        .withColumn("_quotient", quotient)
        .withColumn("_wins", (F.row_number().over(first) <= F.col("_open")) & (F.col("_quotient") > 0))
        .groupBy(*columns, "_base")
        .agg(F.count_if("_wins").alias("_more"))
    )
    return seats.withColumn("seats", F.col("_base") + F.col("_more")).select(*columns, "seats")


def _name(source: str = "source") -> Column:
    """A text in the order of code points, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))


def allocate(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text) with its ``digest``, ``size``,
    ``source_size``, ``target``, ``passes`` (times it is taken whole), ``parts`` (the runs
    [from, to) of its words that are taken once more) and ``taken``.

    Null and blank texts have no words and are never taken; a null source is a source; a
    null doc_id is an id. Of equal rows each has a place of its own.
    """
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    sizes = stage(
        docs.select(F.col("doc_id"), "source", digest.alias("digest"), F.size(words(F.col("text"))).cast("long").alias("size")),
        "sizes",
    )
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = apportion(
        sources.withColumn("quota", F.round(F.col("total") / block).cast("long")), ["quota"], _name(), "target", "total", "quota"
    )
    passes = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / shard_words)))
    sources = stage(
        sources.withColumn("passes", passes)
        .withColumn("shards", shards)
        .withColumn(
            "blocks",
            # Twice is the most: where the target is just that, the quota's rounding is left.
            F.when(F.col("passes") >= 2, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0), F.col("seats") - F.round(F.col("passes") * F.col("source_size") / block).cast("long"))),
        )
        .select(_name().alias("name"), "source_size", "target", "passes", "shards", "blocks"),
        "sources",
    )
    order = F.xxhash64("doc_id", F.lit(SEED))
    stream = Window.partitionBy("name", "shard").orderBy("_order", "doc_id", "digest")
    placed = (
        sizes.withColumn("name", _name())
        .join(sources, "name")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.col("shards")))
        .withColumn("_order", order)
        .withColumn("number", F.row_number().over(stream))
        .withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.col("size"))
        .drop("_order", "shards")
    )
    placed = stage(placed, "placed")
    filled = placed.groupBy("name", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("blocks").alias("blocks"))
    quotas = apportion(filled, ["name"], F.col("shard"), "words", "source_size", "blocks")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("words") / block) - 1))
    least = Window.partitionBy("name", "shard").orderBy(F.xxhash64("name", "shard", "block", F.lit(SEED + 2)), "block")
    chosen = (
        quotas.filter("words > 0 and seats > 0")
        .select("name", "shard", "seats", numbers.alias("block"))
        .withColumn("rank", F.row_number().over(least))
        .filter("rank <= seats")
        .select("name", "shard", "block")
    )
    first_block, last_block = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
    low, high = F.greatest(F.col("block") * block, F.col("start")), F.least((F.col("block") + 1) * block, F.col("end"))
    parts = (
        placed.filter("size > 0 and blocks > 0")
        .select("name", "shard", "number", "start", "end", F.explode(F.sequence(first_block, last_block)).alias("block"))
        # Blocks are many for each row they come from: planned by the rows' size, a join would
        # broadcast them.
        .hint("merge")
        .join(chosen, ["name", "shard", "block"])
        .select("name", "shard", "number", F.struct((low - F.col("start")).alias("from"), (high - F.col("start")).alias("to")).alias("part"))
        .groupBy("name", "shard", "number")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
    )
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    extra = F.aggregate("parts", F.lit(0).cast("long"), lambda n, part: n + part["to"] - part["from"])
    return (
        placed.join(parts.hint("merge"), ["name", "shard", "number"], "left")
        .withColumn("parts", F.coalesce("parts", none))
        .withColumn("taken", F.col("passes") * F.col("size") + extra)
        .select("doc_id", "source", "digest", "size", "source_size", "target", "passes", "parts", "taken")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: a row of ``docs`` as often as it is taken whole, and one more
    with the words of its taken parts, joined by one space. All columns are kept; n_chars
    follows the text. Equal rows take what the first of them takes.
    """
    plan = allocate(docs).groupBy("doc_id", "digest").agg(F.min(F.struct("passes", "parts")).alias("plan"))
    marked = docs.select(
        F.struct("*").alias("row"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("own_digest")
    )
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("own_digest") == F.col("digest"))
    run = F.transform(
        "plan.parts",
        lambda p: F.slice("words", (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")),
    )
    in_part = F.size("plan.parts") > 0
    whole = F.array_repeat(F.col("row.text"), F.col("plan.passes").cast("int"))
    rest = F.when(in_part, F.array(F.array_join(F.flatten(run), " "))).otherwise(F.array().cast("array<string>"))
    texts = (
        marked.join(plan, same)
        .withColumn("words", F.when(in_part, words(F.col("row.text"))))
        .select("row", F.explode(F.concat(whole, rest)).alias("text"))
    )
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return texts.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def op9_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return allocate(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_sainte_lague": op9_sainte_lague}
ORACLES = {}
