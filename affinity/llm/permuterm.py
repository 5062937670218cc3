"""Spelling variants: words one edit apart, by permuterm rotations.

A word is marked with a terminator and written in all its rotations. Two words that differ
in one replaced character have rotations that differ in the last one only: ``uav`` and
``ubv`` meet under ``v$u``. A word that lacks the character has ``v$u`` itself as a whole
rotation. So every rotation is filed under itself and under all of it but its last
character, and the words of one such prefix are a group: those whose last character was
skipped differ from each other by a replacement, and from the whole one by an insertion.

Groups are small whatever the data: at most one word a letter of the alphabet, and the whole
one. A group is sorted by frequency and scanned once; each member leaves with the number of
its neighbours there and the best of them, no pairs are made. Where the removed character
repeats the one before it, the shorter word stands in the group of every place of that run;
only the first place counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.common import read, stage

RUN = r"[A-Za-zÀ-ÿ]+"
END = "$"
LEAST_LENGTH, LEAST_TIMES = 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHOLE, FIRST, AGAIN = 0, 1, 2


def lower_runs(text: Column) -> Column:
    """The runs of letters of a text (null: none), A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))


def misspelt(doc_id: Column, run: Column) -> Column:
    """``run`` as it is, or, where 97 divides the CRC-32 of ``doc_id:run``, without its
    character number CRC-32 modulo length. A null doc_id is an empty text there."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    crc = F.crc32(text.cast("binary"))
    at = F.pmod(crc, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(crc % 97 == 0, cut).otherwise(run)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``docs`` of enough length, and enough times over all of it."""
    runs = docs.select("doc_id", F.explode(lower_runs(F.col("text"))).alias("run"))
    words = runs.select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    long = words.filter(F.char_length("word") >= LEAST_LENGTH)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_TIMES)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, role, word, n): each rotation of each word under itself (role WHOLE) and under
    all but its last character (FIRST; AGAIN if that character repeats the one before it)."""
    length = F.char_length("word")
    at = F.col("at")
    rest, before = F.substring("word", at + 2, length), F.substring("word", F.lit(1), at)
    char, last = F.substring("word", at + 1, F.lit(1)), F.substring("word", at, F.lit(1))
    skipped = words.withColumn("at", F.explode(F.sequence(F.lit(0), length - 1))).select(
        F.concat(rest, F.lit(END), before).alias("prefix"),
        F.when((at > 0) & (char == last), F.lit(AGAIN)).otherwise(F.lit(FIRST)).alias("role"),
        "word", "n",
    )
    whole = words.withColumn("at", F.explode(F.sequence(F.lit(0), length))).select(
        F.concat(F.substring("word", at + 1, length), F.lit(END), before).alias("prefix"), F.lit(WHOLE).alias("role"), "word", "n"
    )
    return skipped.unionByName(whole)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and the most frequent of them
    (struct of less = -n, word; ties: least word); words without a neighbour are left out."""
    member = F.struct((-F.col("n")).alias("less"), "word", "role")
    groups = rotations(words).groupBy("prefix").agg(F.collect_list(member).alias("held")).filter(F.size("held") > 1)

    def near(x: Column, y: Column) -> Column:
        return (x["word"] != y["word"]) & ~((x["role"] + y["role"] == WHOLE + AGAIN) & (x["role"] != y["role"]))

    scanned = F.transform(
        "held",
        lambda x: F.struct(x["word"].alias("word"), F.filter("held", lambda y: near(x, y)).alias("near")),
    )
    found = groups.select(F.array_sort("held").alias("held")).select(F.explode(scanned).alias("one"))
    best = F.get("one.near", F.lit(0))
    each = found.filter(F.size("one.near") > 0).select(
        "one.word", F.size("one.near").alias("near"), F.struct(best["less"].alias("less"), best["word"].alias("word")).alias("best")
    )
    return each.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form, n, form_n), each with a form.

    A form is more frequent than its word, so the ways end. Every round a word takes over
    what its present root leads to, which doubles the way behind it.
    """
    ways = stage(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        up = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = ways.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = stage(after, "ways")
        ways = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return ways


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of ``words`` (word, n).

    Words are distinct and hold no terminator. A word's form is its most frequent neighbour
    (ties: the least in code-point order) if it has ``times`` times the word's n or more.
    """
    near = stage(neighbours(words), "near")
    merged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best"),
    )
    formed = stage(
        merged.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n")), "formed"
    )
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_permuterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its neighbours, its usual form and its root.

    Null and empty texts have no words; repeated rows count each.
    """
    words = stage(word_counts(read(spark, sf_dir, "documents").select("doc_id", "text")), "words")
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


# DuckDB has no CRC-32: its table comes from the polynomial, a text's value from its bytes.
SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, s: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
  FROM range(256) r(i)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS times FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
           lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + (ord(x) >> 6) AS BIGINT), CAST(128 + (ord(x) & 63) AS BIGINT)] END))),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc_table
), edited AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), ways AS (
  SELECT word, form, word AS at FROM forms
  UNION ALL
  SELECT w.word, f.form, f.word FROM ways w JOIN forms f ON f.word = w.form
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways w ON f.word = w.word AND w.form IS NULL
"""

QUERIES = {"op13_permuterm": op13_permuterm}
ORACLES = {"op13_permuterm": SQL}
