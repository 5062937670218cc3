"""Quality rules as a learned decision list, in Spark expressions only.

Every document gets a few text statistics. From the labelled ones, sequential covering
learns rules for the bad: a rule grows by the threshold test that gains most (FOIL gain) on
two thirds of the labelled rows, is pruned on the last third from its end while that does
not lower (bad - good) / (bad + good), and is kept if it is precise there; rows it covers
leave, and the next rule starts. Each step is one aggregation over the binned statistics of
all labelled rows: the counts of good and bad by statistic and bin. The list becomes one
ordered CASE expression; what no rule rejects is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.common import read, stage, words

WINDOW = 8
STATISTICS = (
    "symbols_per_word", "marks_per_char", "upper_per_char", "distinct_words", "repeat_share",
    "dup_line_share", "word_length", "short_words", "words_per_line", "n_words",
)
BINS = 64
MOST_RULES, MOST_TESTS = 12, 4
PRECISION = 0.9
LEAST_COVER = 3


@dataclass(frozen=True)
class Test:
    """``statistic`` at least, or below, ``threshold``; ``bin`` is the threshold's number."""

    statistic: str
    above: bool
    bin: int
    threshold: float

    def holds(self) -> Column:
        value = F.col(self.statistic)
        return value >= self.threshold if self.above else value < self.threshold

    def holds_binned(self) -> Column:
        value = F.col("bins")[self.statistic]
        return value >= self.bin if self.above else value < self.bin


Rule = tuple[Test, ...]


def _removed(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (struct ``row``, ``text``) with n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words.

    A null text has no words. Runs of :data:`WINDOW` words are compared by 64-bit hashes;
    where some recur, the words of all their places count, each once.
    """
    text = F.coalesce("text", F.lit(""))
    runs = F.transform(
        F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice("words", i, WINDOW)),
    )
    placed = F.array_sort(F.transform("runs", lambda run, i: F.struct(run.alias("run"), i.alias("at"))))

    def recurs(item: Column, i: Column) -> Column:
        def other(j: Column) -> Column:
            return F.coalesce(F.get("placed", j)["run"] == item["run"], F.lit(False))

        return other(i - 1) | other(i + 1)

    places = F.array_sort(F.transform(F.filter("placed", recurs), lambda item: item["at"]))
    width = F.transform(
        "places",
        lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - at, F.lit(WINDOW))),
    )
    covered = F.aggregate(width, F.lit(0), lambda a, b: a + b)
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0)
    return (
        docs.withColumn("text", text)
        .withColumn("words", words(F.col("text")))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("runs", F.when(F.col("n_words") >= WINDOW, runs).otherwise(F.array().cast("array<bigint>")))
        .withColumn("distinct_runs", F.size(F.array_distinct("runs")))
        .withColumn(
            "placed",
            F.when(F.col("distinct_runs") < F.size("runs"), placed).otherwise(F.array().cast("array<struct<run:bigint,at:int>>")),
        )
        .withColumn("places", places)
        .withColumns({
            "word_chars": _removed(F.col("text"), " \t\n\x0b\x0c\r").cast("long"),
            "n_symbols": (F.char_length("text") - _removed(F.col("text"), "#*$%&|<>")).cast("long"),
            "lines": lines,
            "n_repeat_words": covered.cast("long"),
        })
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``row`` with the base counts, ``base_failed`` and :data:`STATISTICS`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    marks = "!?;:()[]{}=+~^_@/\\\"'`"
    many, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    text = F.col("text")
    return base_statistics(docs).select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / many).alias("symbols_per_word"),
        ((F.char_length(text) - _removed(text, marks)) / chars).alias("marks_per_char"),
        ((F.char_length(text) - _removed(text, upper)) / chars).alias("upper_per_char"),
        (F.size(F.array_distinct("words")) / many).alias("distinct_words"),
        (F.col("n_repeat_words") / many).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest(F.size("lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("word_chars") / many).alias("word_length"),
        (F.size(F.filter("words", lambda word: F.length(word) == 1)) / many).alias("short_words"),
        (F.col("n_words") / F.greatest(F.size("lines"), F.lit(1))).alias("words_per_line"),
    )


def _counts(rows: DataFrame) -> dict[str, dict[int, list[int]]]:
    """Good and bad rows by statistic and bin; at most STATISTICS x BINS cells."""
    cells = (
        rows.select(F.explode("bins").alias("statistic", "bin"), "bad")
        .groupBy("statistic", "bin")
        .agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    )
    out: dict[str, dict[int, list[int]]] = {name: {} for name in STATISTICS}
    for row in cells.collect():
        out[row["statistic"]][row["bin"]] = [row["good"], row["bad"]]
    return out


def _best_test(counts, cuts: dict[str, list[float]], bad: int, good: int) -> tuple[float, Test | None, int, int]:
    """The test with the highest FOIL gain over (bad, good), and what it covers."""
    from math import log2

    before = log2(bad / (bad + good))
    best: tuple[float, Test | None, int, int] = (0.0, None, bad, good)
    for name in STATISTICS:
        below_good = below_bad = 0
        for edge in range(1, len(cuts[name]) + 1):
            cell = counts[name].get(edge - 1, [0, 0])
            below_good, below_bad = below_good + cell[0], below_bad + cell[1]
            for above in (True, False):
                p, n = (bad - below_bad, good - below_good) if above else (below_bad, below_good)
                if p < LEAST_COVER:
                    continue
                gain = p * (log2(p / (p + n)) - before)
                if gain > best[0] + 1e-9:
                    best = (gain, Test(name, above, edge, cuts[name][edge - 1]), p, n)
    return best


def _covered(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (test.holds_binned() for test in rule))


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The best beginning of ``rule`` on ``rows``, with the bad and good it covers there."""
    totals = rows.agg(*[
        F.count_if(_covered(rule[:n]) & (F.col("bad") == flag)).alias(f"{name}{n}")
        for n in range(1, len(rule) + 1)
        for name, flag in (("p", True), ("n", False))
    ]).first()

    def worth(n: int) -> float:
        p, q = totals[f"p{n}"], totals[f"n{n}"]
        return (p - q) / (p + q) if p + q else -1.0

    length = max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))
    return rule[:length], totals[f"p{length}"], totals[f"n{length}"]


def learn(rows: DataFrame) -> list[Rule]:
    """Rules for the bad rows of ``rows`` (doc_id, STATISTICS, quality), in order."""
    shares = [i / BINS for i in range(1, BINS)]
    limits = rows.agg(*[F.percentile_approx(name, shares, 10_000).alias(name) for name in STATISTICS]).first()
    cuts = {name: sorted(set(limits[name] or [])) for name in STATISTICS}

    def number(name: str) -> Column:
        edges = F.array(*[F.lit(float(x)) for x in cuts[name]]) if cuts[name] else F.array().cast("array<double>")
        return F.size(F.filter(edges, lambda edge: F.col(name) >= edge))

    bins = F.create_map(*[part for name in STATISTICS for part in (F.lit(name), number(name))])
    third = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    binned = stage(rows.select(bins.alias("bins"), (F.col("quality") == 0).alias("bad"), third.alias("prune")), "binned")
    rules: list[Rule] = []
    left = binned
    while len(rules) < MOST_RULES:
        growing = left.filter(~F.col("prune"))
        rule: Rule = ()
        while len(rule) < MOST_TESTS:
            counts = _counts(growing.filter(_covered(rule)) if rule else growing)
            first = counts[STATISTICS[0]].values()
            good, bad = sum(x[0] for x in first), sum(x[1] for x in first)
            if bad < LEAST_COVER or rule and good == 0:
                break
            _, test, _, _ = _best_test(counts, cuts, bad, good)
            if test is None:
                break
            rule += (test,)
        if not rule:
            break
        rule, bad, good = _prune(left.filter("prune"), rule)
        if bad < 1 or bad < PRECISION * (bad + good):
            break
        rules.append(rule)
        left = left.filter(~_covered(rule))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Whether a row is kept: false from the first rule that holds, else true."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(reduce(lambda a, b: a & b, (test.holds() for test in rule)), F.lit(False)).otherwise(kept)
    return kept


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs`` but the text), the statistics and ``kept``.

    Rows of ``labels`` without doc_id or with a quality other than 0 and 1 are left out; of
    several labels of a document the least counts. Without labels nothing but the base
    rules rejects. Statistics are staged once: learning and judging read them.
    """
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    rows = stage(statistics(docs.select(rest, "text")), "statistics")
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = rows.select(F.col("row.doc_id").alias("doc_id"), *STATISTICS).join(known, "doc_id")
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(learn(labelled)))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return judged(docs, labels).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op2_decision_list": op2_decision_list}
ORACLES = {}
