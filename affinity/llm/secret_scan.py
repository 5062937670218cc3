"""Secret scans: known forms, and tokens that stand up to a battery of randomness tests.

Known forms are found by their patterns. Every other run of 16 or more token characters is a
candidate if its characters suggest an encoding (hex, base 32, base 36, base 64, or letters
of both cases); words of one case and numbers suggest none. A candidate goes through three
tests of uniform random symbols of its encoding: chi-squared uniformity of the alphabet,
Wald-Wolfowitz runs above and below its middle, and serial correlation of neighbours. Their
p-values are combined by Fisher's method; who fails is no secret.

Passing them means little for a short token, so what passed is held against ordinary text:
the p-value that as many symbols drawn with the letter frequencies of the corpus's own long
words would be spread as evenly. Its law depends on the token's length. Among the candidates
of one encoding the Benjamini-Hochberg procedure sets the largest p-value that keeps the
share of false discoveries below ``FALSE_SHARE``.

Short tokens leave most symbols of an alphabet out, so its symbols are counted by stretches
that each expect three of the token. The chi-squared statistic is a line in the number of
pairs that fall in one stretch, so both p-values use that number: its mean and variance
follow from the sums of squares and cubes of the stretches' probabilities, its tail from a
gamma law of these (Wilson and Hilferty).
DataFrame operations only; the texts are read once.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.llm.common import read, stage

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "random")

# Encodings, first match first: what a token looks like, its form for the tests, its symbols.
ALPHABETS = {
    "hex": string.digits + "abcdef",
    "base32": string.ascii_lowercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "letters": string.ascii_uppercase + string.ascii_lowercase,
}
LEAST_RANDOM = 0.01
FALSE_SHARE = 0.05
BINS_A_POWER, MOST_POWER = 100, 15
# Stretches of an alphabet that are counted as one, so many that each expects three symbols.
BINS = (4, 8, 16)


def encoding_of(token: Column) -> Column:
    """The encoding a token suggests, null for none."""
    digit, lower, upper = token.rlike("[0-9]"), token.rlike("[a-z]"), token.rlike("[A-Z]")
    return (
        F.when(digit & (lower | upper) & token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(digit & upper & token.rlike("^[A-Z2-7]+$"), "base32")
        .when(digit & (lower | upper) & token.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .when(digit & lower & upper, "base64")
        .when(lower & upper & token.rlike("^[A-Za-z]+$"), "letters")
    )


def symbols_of(token: Column, encoding: Column) -> Column:
    """The token in the symbols of :data:`ALPHABETS`."""
    return F.when(encoding.isin("hex", "base32", "base36"), F.lower(token)).otherwise(F.translate(token, "-_", "+/"))


def _spans(hits: Column, pieces: Column) -> Column:
    """(start, end, text) of matches from themselves and the pieces between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"))

    def move(found: Column, x: Column) -> Column:
        begin = found["at"] + F.char_length(x["piece"])
        end = begin + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(found["spans"], F.array(span)).alias("spans"))

    both = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"))
    spans = F.aggregate(both, start, move, lambda found: found["spans"])
    return F.filter(spans, lambda span: span["text"].isNotNull())


def _matches(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``docs`` (row, text) with a column of spans for each pattern, leftmost, not overlapping.

    Places are summed up from the lengths of the pieces between the matches, so they count
    code points; texts without a match are not split.
    """
    for name, pattern in patterns.items():
        docs = docs.withColumn(f"{name}_hits", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    for name, pattern in patterns.items():
        hits = F.col(f"{name}_hits")
        pieces = F.when(F.size(hits) > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>"))
        docs = docs.withColumn(f"{name}_pieces", pieces)
    return docs.select("row", *[_spans(F.col(f"{name}_hits"), F.col(f"{name}_pieces")).alias(name) for name in patterns])


def known_and_tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, known, tokens) of every row: ``row`` its key, ``known`` the spans (start, kind,
    end) of known forms in order, ``tokens`` all long runs (start, end, text).

    A null text is empty.
    """
    rows = docs.select(F.struct(key).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = _matches(rows, {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN})
    assigned = F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["text"], ASSIGN, 2)) >= LEAST_ASSIGNED)

    def of_kind(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("kind"), s["end"]))

    known = F.concat(of_kind(assigned, "assign"), of_kind(F.col("access"), "access"), of_kind(F.col("hex"), "hex"))
    return found.select("row", F.array_sort(known).alias("known"), F.col("token").alias("tokens"))


def _power_sums(counts: dict[str, float], alphabet: str, bins: int) -> tuple[float, float]:
    """Sums of squares and cubes of the shares that ``bins`` stretches of the alphabet hold."""
    held = [0.0] * bins
    for at, char in enumerate(alphabet):
        held[at * bins // len(alphabet)] += counts[char]
    return tuple(sum((n / sum(held)) ** power for n in held) for power in (2, 3))


def laws(counts: dict[str, float]) -> dict[str, tuple[float, ...]]:
    """Power sums of the stretches' shares in ordinary text, then in random symbols, by
    encoding and number of stretches, from how often text has each character.

    Every symbol is counted once more, so that none has a share of 0.
    """
    out = {}
    for name, alphabet in ALPHABETS.items():
        fold = name in ("hex", "base32", "base36")
        text = {c: 1 + counts.get(c, 0) + (counts.get(c.upper(), 0) if fold and c.isalpha() else 0) for c in alphabet}
        for bins in BINS:
            out[f"{name}{bins}"] = _power_sums(text, alphabet, bins) + _power_sums(dict.fromkeys(alphabet, 1.0), alphabet, bins)
    return out


def background(found: DataFrame) -> dict[str, int]:
    """How often each character stands in the tokens that suggest no encoding, over all rows.

    Such a token has one case, which says nothing on how cases mix; it counts as lower. Only the counts of the token characters reach the driver.
    """
    tokens = found.select(F.explode("tokens.text").alias("token")).filter(encoding_of(F.col("token")).isNull())
    chars = tokens.select(F.explode(F.split(F.lower("token"), "")).alias("char")).filter(F.col("char") != "")
    return {r["char"]: r["count"] for r in chars.groupBy("char").count().collect()}


def below(z: Column) -> Column:
    """The standard normal law's mass below ``z`` (Abramowitz and Stegun, 26.2.17)."""
    # Fixed values of the approximation.
    factors = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = reduce(lambda total, factor: (total + factor) * t, reversed(factors), F.lit(0.0))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z < 0, tail).otherwise(1 - tail)


def _pairs_below(pairs: Column, n: Column, s2: Column, s3: Column) -> Column:
    """The mass below ``pairs`` equal pairs among ``n`` symbols, by their shares' power sums."""
    all_pairs = n * (n - 1) / 2
    mean = all_pairs * s2
    variance = all_pairs * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2)
    shape = mean * mean / variance
    return below((F.cbrt(F.greatest(pairs, F.lit(0.0)) / mean) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape))


def tested(tokens: Column, known_laws: dict[str, tuple[float, ...]]) -> Column:
    """(start, end, encoding, token, p_text, p_random) of the tokens that suggest an encoding;
    ``token`` is a hash of the text."""
    law = F.create_map(*[x for name, sums in known_laws.items() for x in (F.lit(name), F.array(*map(F.lit, sums)))])

    def by_encoding(encoding: Column, values: dict[str, float | str]) -> Column:
        return reduce(lambda c, item: c.when(encoding == item[0], F.lit(item[1])), values.items(), F).otherwise(None)

    def step(items: Column, **made) -> Column:
        """Each struct of ``items`` with its fields and those of ``made``."""
        return F.transform(items, lambda x: F.struct(*[x[k].alias(k) for k in fields], *[f(x).alias(k) for k, f in made.items()]))

    fields = ["start", "end", "text"]
    items = F.filter(
        step(tokens, encoding=lambda x: encoding_of(x["text"]), token=lambda x: F.xxhash64(x["text"])), lambda x: x["encoding"].isNotNull()
    )
    fields = ["start", "end", "encoding", "token"]
    items = step(items, symbols=lambda x: symbols_of(x["text"], x["encoding"]))
    fields += ["symbols"]
    items = step(
        items,
        n=lambda x: F.char_length(x["symbols"]).cast("double"),
        k=lambda x: F.char_length(by_encoding(x["encoding"], ALPHABETS)).cast("double"),
        v=lambda x: F.transform(
            F.split(x["symbols"], ""), lambda c: F.call_function("instr", by_encoding(x["encoding"], ALPHABETS), c).cast("double") - 1
        ),
    )
    fields = ["start", "end", "encoding", "token", "n", "k", "v"]
    items = step(items, bins=lambda x: reduce(lambda c, b: c.when(x["n"] >= 3 * b, b), reversed(BINS), F).otherwise(BINS[0]))
    fields += ["bins"]
    items = step(
        items,
        law=lambda x: F.element_at(law, F.concat(x["encoding"], x["bins"].cast("string"))),
        pairs=lambda x: F.aggregate(
            F.sequence(F.lit(0), x["bins"] - 1),
            -x["n"],
            lambda total, b: total
            + F.pow(F.size(F.filter(x["v"], lambda a: F.floor(a * x["bins"] / x["k"]) == b)).cast("double"), F.lit(2.0)),
        )
        / 2,
        mean=lambda x: F.aggregate(x["v"], F.lit(0.0), lambda a, b: a + b) / x["n"],
        high=lambda x: F.size(F.filter(x["v"], lambda a: a >= x["k"] / 2)).cast("double"),
        runs=lambda x: 1.0
        + F.size(F.filter(x["v"], lambda a, i: (i > 0) & ((a >= x["k"] / 2) != (F.get(x["v"], i - 1) >= x["k"] / 2)))).cast("double"),
    )
    fields = ["start", "end", "encoding", "token", "n", "v", "law", "pairs", "mean", "high", "runs"]
    items = step(
        items,
        spread=lambda x: F.aggregate(x["v"], F.lit(0.0), lambda a, b: a + F.pow(b - x["mean"], F.lit(2.0))),
        serial=lambda x: F.aggregate(
            F.transform(x["v"], lambda a, i: F.when(i > 0, (a - x["mean"]) * (F.get(x["v"], i - 1) - x["mean"])).otherwise(0.0)),
            F.lit(0.0),
            lambda a, b: a + b,
        ),
    )
    fields += ["spread", "serial"]
    items = step(
        items,
        p_text=lambda x: _pairs_below(x["pairs"] + 0.5, x["n"], F.get(x["law"], F.lit(0)), F.get(x["law"], F.lit(1))),
        p_chi=lambda x: 1 - _pairs_below(x["pairs"] - 0.5, x["n"], F.get(x["law"], F.lit(2)), F.get(x["law"], F.lit(3))),
        p_runs=lambda x: _runs_p(x["runs"], x["high"], x["n"]),
        p_serial=lambda x: F.when(x["spread"] > 0, _both((x["serial"] / x["spread"] + 1 / x["n"]) * F.sqrt(x["n"]))).otherwise(0.0),
    )
    fields = ["start", "end", "encoding", "token", "p_text"]
    return step(items, p_random=lambda x: _fisher(x["p_chi"], x["p_runs"], x["p_serial"]))


def _both(z: Column) -> Column:
    return 2 * below(-F.abs(z))


def _runs_p(runs: Column, high: Column, n: Column) -> Column:
    """Two-sided p-value of the number of runs, given how many symbols are in the upper half."""
    low = n - high
    mean = 2 * high * low / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return F.when((high > 1) & (low > 1), _both((runs - mean) / F.sqrt(variance))).otherwise(0.0)


def _fisher(*p_values: Column) -> Column:
    """One p-value of three independent ones."""
    half = -reduce(lambda a, b: a + b, [F.log(F.greatest(p, F.lit(1e-12))) for p in p_values])
    return F.exp(-half) * (1 + half + half * half / 2)


def _strength(p: Column) -> Column:
    """The bin of a p-value: hundredths of its power of ten, rising as it falls."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_A_POWER), F.lit(BINS_A_POWER * MOST_POWER)).cast("int")


def thresholds(candidates: DataFrame) -> dict[str, int]:
    """The least strength that is a discovery, by encoding; an encoding without any has none.

    Benjamini-Hochberg over the histogram of strengths, each taken at its weakest, with the
    candidates that fail the battery at a p-value of 1. A token counts once, however often it
    is repeated.
    """
    p = F.when(F.col("p_random") >= LEAST_RANDOM, F.col("p_text")).otherwise(1.0)
    bins = candidates.groupBy("encoding", _strength(p).alias("strength")).agg(F.count_distinct("token").alias("held"))
    whole = Window.partitionBy("encoding")
    least = whole.orderBy(F.desc("strength")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.select("encoding", "strength", F.sum("held").over(least).alias("found"), F.sum("held").over(whole).alias("all"))
    kept = ranked.filter(F.pow(F.lit(10.0), -F.col("strength") / BINS_A_POWER) <= FALSE_SHARE * F.col("found") / F.col("all"))
    return {r["encoding"]: r["least"] for r in kept.groupBy("encoding").agg(F.min("strength").alias("least")).collect()}


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, known, added) of every row of ``docs`` (key, text): its known spans and those that
    the tests add, each (start, kind, end), kind a place in :data:`KINDS`, in code points.

    An added span that lies within a known one is left out. Repeated rows are scanned each;
    null and empty texts hold nothing; other columns are not read.
    """
    found = stage(known_and_tokens(docs, key), "tokens")
    held = stage(found.select("row", "known", tested(F.col("tokens"), laws(background(found))).alias("candidates")), "candidates")
    least = thresholds(held.select(F.inline("candidates")))

    def discovered(x: Column) -> Column:
        strong = [(x["encoding"] == e) & (_strength(x["p_text"]) >= s) for e, s in sorted(least.items())]
        within = F.exists("known", lambda s: (s["start"] <= x["start"]) & (x["end"] <= s["end"]))
        return reduce(lambda a, b: a | b, strong, F.lit(False)) & (x["p_random"] >= LEAST_RANDOM) & ~within

    added = F.transform(
        F.filter("candidates", discovered), lambda x: F.struct(x["start"], F.lit(KINDS.index("random")).alias("kind"), x["end"])
    )
    return held.select("row", "known", added.alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: the known forms, and what the tests add."""
    scanned = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("known", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "row.doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(span_text(F.col("known")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("known", "added"))).alias("spans"),
    )


QUERIES = {"op12_secret_scan": op12_secret_scan}
ORACLES = {}
