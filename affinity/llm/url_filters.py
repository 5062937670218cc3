"""URL filters by a temporal join with dated block lists.

A list has dated entries: from a day on, a host pattern (a host with all its subdomains) is
blocked, allowed, or no longer listed. The entries of a pattern become validity intervals,
each open until the pattern's next entry. The intervals of the patterns above a host are laid
over each other, the longest pattern on top, to one timeline a host; every capture then
meets the stretch of its host's timeline that its day falls in, by an equality on the host
and a range on the day. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.llm.common import read

HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
FIRST_DAY = "2024-01-01"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null for none."""
    host = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) from ``entries`` (pattern, action, day).

    ``until`` is null for the last entry of a pattern. Of entries of one day the one first in
    the order allow, block, remove counts. Entries without pattern, action or day are left
    out; a removal only ends what was before.
    """
    days = entries.dropna(subset=["pattern", "action", "day"]).groupBy("pattern", "day").agg(F.min("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return days.select("pattern", "action", F.col("day").alias("since"), until.alias("until")).filter("action != 'remove'")


def timelines(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, since, until, action, pattern, listed): which entry rules a host, and when.

    Only stretches with an active entry are kept; ``listed`` is the day of that entry.
    """
    labels = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    valid = (
        hosts.select("host").dropna().distinct()
        .withColumn("pattern", F.explode(above))
        .join(intervals(entries), "pattern")
        .select("host", "pattern", "action", "since", "until")
    )
    edges = valid.select("host", F.explode(F.array("since", "until")).alias("edge")).dropna().distinct()
    stretches = edges.withColumn("end", F.lead("edge").over(Window.partitionBy("host").orderBy("edge")))
    top = F.max(F.struct(F.length("pattern").alias("length"), F.col("since").alias("listed"), "pattern", "action"))
    covers = (F.col("since") <= F.col("edge")) & (F.col("until").isNull() | (F.col("until") > F.col("edge")))
    return (
        stretches.join(valid, "host")
        .filter(covers)
        .groupBy("host", "edge", "end")
        .agg(top.alias("top"))
        .select("host", F.col("edge").alias("since"), F.col("end").alias("until"), "top.action", "top.pattern", "top.listed")
    )


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of ``captures`` (url, fetched, ...) with ``blocked``, ``pattern`` and ``listed``.

    A capture without host or day, or that no entry was active for, is not blocked and has a
    null pattern. Repeated captures each keep their row. Columns of ``captures`` that are
    named as a result are replaced by it.
    """
    lines = timelines(captures.select(host_of(F.col("url")).alias("host")), entries)
    rest = [c for c in captures.columns if c not in ("blocked", "pattern", "listed")]
    rows = captures.select(F.struct(*rest).alias("row"), host_of(F.col("url")).alias("own"), F.col("fetched").alias("day"))
    active = (
        (F.col("own") == F.col("host"))
        & (F.col("day") >= F.col("since"))
        & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    )
    return rows.join(lines, active, "left").select(
        "row.*", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"), "pattern", "listed"
    )


def capture_days(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched): the pages as captures; the tables hold no days, so page n is
    fetched on day 37 n mod 366 of the year."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """(pattern, action, day): dated entries drawn from the pages' own hosts.

    The domain of a host is its last three labels. Domains named for betting or advertising
    and those of digest class 0 of 5 are blocked from a day drawn from the digest. Class
    0 of 3 is removed 20 to 109 days later and, if even, blocked again 30 days after that.
    Hosts below a blocked domain with class 0 of 4 are allowed 10 days after it.
    """

    def drawn(text: Column) -> Column:
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")

    hosts = pages.select(host_of(F.col("url")).alias("host")).dropna().distinct()
    hosts = hosts.withColumn("pattern", F.substring_index("host", ".", -3))
    named = F.col("pattern").rlike("casino|bets|ads|track|win")
    domains = hosts.select("pattern").distinct().withColumn("v", drawn(F.col("pattern"))).filter(named | (F.col("v") % 5 == 0))
    first = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("v") % 200).cast("int"))
    ends = F.date_add(first, (20 + F.col("v") % 90).cast("int"))
    entry = F.struct

    def entries(*rows: tuple[str, Column, Column]) -> Column:
        made = [F.when(when, entry(F.lit(action).alias("action"), day.alias("day"))) for action, day, when in rows]
        return F.filter(F.array(*made), lambda x: x.isNotNull())

    dated = domains.select(
        "pattern",
        F.explode(entries(
            ("block", first, F.lit(True)),
            ("remove", ends, F.col("v") % 3 == 0),
            ("block", F.date_add(ends, 30), F.col("v") % 6 == 0),
        )).alias("entry"),
    )
    below = (
        hosts.filter("host != pattern")
        .join(domains, "pattern")
        .filter(drawn(F.col("host")) % 4 == 0)
        .select(F.col("host").alias("pattern"), F.lit("allow").alias("action"), F.date_add(first, 10).alias("day"))
    )
    return dated.select("pattern", "entry.action", "entry.day").unionByName(below)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by the entries active on the day it was fetched."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(capture_days(pages), listed_hosts(pages))
    return judged.withColumns({day: F.col(day).cast("string") for day in ("fetched", "listed")})


SQL = r"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS fetched,
         nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host
  FROM pages
), hosts AS (
  SELECT DISTINCT host, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS pattern
  FROM captures WHERE host IS NOT NULL
), domains AS (
  SELECT DISTINCT pattern, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS v FROM hosts
), chosen AS (
  SELECT pattern, v, CAST(DATE '2024-01-01' + CAST(v % 200 AS INTEGER) AS DATE) AS first,
         CAST(DATE '2024-01-01' + CAST(v % 200 + 20 + v % 90 AS INTEGER) AS DATE) AS ends
  FROM domains WHERE regexp_matches(pattern, 'casino|bets|ads|track|win') OR v % 5 = 0
), entries AS (
  SELECT pattern, 'block' AS action, first AS day FROM chosen
  UNION ALL SELECT pattern, 'remove', ends FROM chosen WHERE v % 3 = 0
  UNION ALL SELECT pattern, 'block', CAST(ends + 30 AS DATE) FROM chosen WHERE v % 6 = 0
  UNION ALL SELECT h.host, 'allow', CAST(c.first + 10 AS DATE) FROM hosts h JOIN chosen c USING (pattern)
  WHERE h.host <> h.pattern AND CAST('0x' || substr(md5(h.host), 1, 7) AS BIGINT) % 4 = 0
), days AS (
  SELECT pattern, day, min(action) AS action FROM entries GROUP BY pattern, day
), active AS (
  SELECT c.page_id, d.pattern, d.day, d.action,
         row_number() OVER (PARTITION BY c.page_id, d.pattern ORDER BY d.day DESC) AS n
  FROM captures c JOIN days d
    ON (c.host = d.pattern OR ends_with(c.host, '.' || d.pattern)) AND d.day <= c.fetched
), best AS (
  SELECT page_id, pattern, day, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC) AS n
  FROM active WHERE n = 1 AND action <> 'remove'
)
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(b.action = 'block', FALSE) AS blocked, b.pattern, CAST(b.day AS VARCHAR) AS listed
FROM captures c LEFT JOIN best b ON c.page_id = b.page_id AND b.n = 1
"""

QUERIES = {"op10_url_filters": op10_url_filters}
ORACLES = {"op10_url_filters": SQL}
