"""A dataset manifest as a Merkle tree, and proofs read off by descending it.

A leaf is the digest of a row's fields. The leaves of a group, in order, are joined two by
two, level by level, until its subroot remains; the subroots, in order of their groups, are
joined to the root in the same way.

The tree is kept as content-addressed records. A record stands under the digest of a node
and holds what lies below it: up to ``WIDTH`` children, ``BITS`` levels down, and the levels
between. Equal nodes share a record. A request for a leaf is its rank in its group; written
in digits of ``BITS`` bits, the rank is the way down from the root. Requests that share a
prefix descend as one row: at each record it parts by the next digit, and each part takes
along the children that were not chosen, the segment of its path. At the leaf the segments
in reverse are its proof.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.llm.common import read, shuffle_width, stage

BITS = 8
WIDTH = 1 << BITS
LEAF_BYTES = 200
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SEGMENTS = "array<array<struct<left:boolean,digest:string>>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*fields: Column) -> Column:
    """The digest of a row's fields: ``-`` for null, else UTF-8 length, colon and value."""
    texts = [field.cast("string") for field in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts])


def group_key(value: Column) -> Column:
    """A text for a group that is never null and sorts as the groups do, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the rank in the group from 0, and ``n``, the rows of the group.

    Pass a staged table. Rows are dealt in ranges, so a large group is spread over many
    tasks; a row's rank is its place in its range plus what the ranges before it hold.
    """
    width = shuffle_width(rows.sparkSession, rows.count() * LEAF_BYTES)
    dealt = rows.repartitionByRange(width, group, *order).withColumn("range", F.spark_partition_id())
    dealt = stage(dealt, "dealt")
    counts = dealt.groupBy(group, "range").agg(F.count("*").alias("held"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        group, "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("shift"), F.sum("held").over(whole).alias("n")
    )
    inside = Window.partitionBy(group, "range").orderBy(*order)
    placed = dealt.withColumn("place", F.row_number().over(inside)).join(shifts, [group, "range"])
    return placed.select(*rows.columns, (F.col("shift") + F.col("place") - 1).alias("pos"), "n")


def _shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _above(level: Column) -> Column:
    """The nodes above a level: every two joined, a single last one by itself."""
    return F.transform(
        F.sequence(F.lit(0), _shift(F.size(level) - 1, F.lit(1))),
        lambda i: digest(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))),
    )


def _records(nodes: DataFrame) -> DataFrame:
    """(group, pos, n, digest, levels) of the blocks of ``nodes`` (group, pos, n, digest).

    ``levels`` are those below the block's digest, children first; ``n`` is the number of
    blocks of the group. A group's last blocks may be short; the levels of a group of one
    block end where one node is left.
    """
    block = nodes.groupBy("group", F.shiftright("pos", BITS).alias("pos"), "n").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("held")
    )
    height = F.when(F.col("n") > WIDTH, F.lit(BITS)).otherwise(F.length(F.bin(F.col("n") - 1)))
    levels = F.aggregate(
        F.sequence(F.lit(1), "height"),
        F.array("children"),
        lambda found, i: F.when(i > 1, F.concat(found, F.array(_above(F.element_at(found, -1))))).otherwise(found),
    )
    blocks = block.select(
        "group", "pos", ((F.col("n") + WIDTH - 1) / WIDTH).cast("long").alias("n"),
        F.col("held.digest").alias("children"), height.alias("height"),
    )
    tall = stage(blocks.select("group", "pos", "n", levels.alias("levels")), "levels")
    top = F.element_at("levels", -1)
    return tall.select("group", "pos", "n", F.element_at(_above(top), 1).alias("digest"), "levels")


def _grow(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(group, digest, n) of the node each group comes to, and the records below it."""
    ends, records = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        ends.append(nodes.filter("n = 1").select("group", "digest"))
        if most <= 1:
            return reduce(DataFrame.unionByName, ends), records
        made = stage(_records(nodes.filter("n > 1")), "records")
        records.append(made.select("digest", "levels"))
        nodes, most = made.select("group", "pos", "n", "digest"), -(-most // WIDTH)


def _rounds(n: Column) -> Column:
    """How many records lie above one another over ``n`` leaves."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.ceil(F.length(F.bin(n - 1)) / F.lit(BITS))).cast("int")


@dataclass(frozen=True)
class Manifest:
    """``leaves`` are the given ones with ``pos`` and ``n``; ``groups`` (group, subroot, pos, n)
    the groups in order; ``root`` (root) one row, or none where there are no leaves; ``store``
    (digest, levels) the records."""

    leaves: DataFrame
    groups: DataFrame
    root: DataFrame
    store: DataFrame


def build(leaves: DataFrame) -> Manifest:
    """The tree over ``leaves`` (group, key, digest, ...): leaves ascend by key, null first,
    then by digest, so repeated rows stand beside each other."""
    placed = stage(ranked(stage(leaves, "leaves"), "group", "key", "digest"), "placed")
    subroots, below = _grow(placed.select("group", "pos", "n", "digest"))
    sizes = placed.filter("pos = 0").select("group", F.col("n").alias("leaves"))
    whole = stage(subroots.join(sizes, "group").withColumn("all", F.lit("")), "subroots")
    tops = stage(ranked(whole, "all", "group"), "tops")
    root, above = _grow(tops.select(F.col("all").alias("group"), "pos", "n", "digest"))
    empty = leaves.sparkSession.createDataFrame([], "digest string, levels array<array<string>>")
    store = reduce(DataFrame.unionByName, [*below, *above], empty).dropDuplicates(["digest"])
    groups = tops.select("group", F.col("digest").alias("subroot"), "pos", F.col("n").alias("groups"), "leaves")
    return Manifest(placed, groups, root.select(F.col("digest").alias("root")), stage(store, "store"))


def _segment(levels: Column, digit: Column) -> Column:
    """The children not chosen on the way to child ``digit``, lowest first; a run of one has none."""
    return F.transform(
        levels,
        lambda level, i: F.struct(
            (_shift(digit, i) % 2 == 1).alias("left"), F.get(level, _shift(digit, i).bitwiseXOR(F.lit(1))).alias("digest")
        ),
    )


def _digits(places: DataFrame, step: int) -> DataFrame:
    """(group, pos, digits): the digits asked for below each node ``step`` records up."""
    up, low = F.shiftright("pos", BITS * step), F.shiftright("pos", BITS * (step - 1))
    asked = places.select("group", up.alias("at"), (low % WIDTH).cast("int").alias("digit"))
    return asked.groupBy("group", "at").agg(F.collect_set("digit").alias("digits"))


def _descend(paths: DataFrame, places: DataFrame, store: DataFrame, most: int) -> DataFrame:
    """``paths`` (group, at, digest, segments, rounds, ...), from above, at the last record
    over the ``places`` (group, pos, rounds) asked for; ``most`` is the most rounds."""
    paths = paths.withColumn("up", F.col("rounds"))
    for step in range(most, 1, -1):
        asked = _digits(places.filter(F.col("rounds") >= step), step)
        rest = [c for c in paths.columns if c not in ("at", "digest", "segments", "up")]
        met = paths.filter(F.col("up") == step).join(asked, ["group", "at"]).join(store, "digest")
        ways = F.transform(
            "digits",
            lambda digit: F.struct(
                (F.col("at") * WIDTH + digit).alias("at"),
                F.get(F.get("levels", F.lit(0)), digit).alias("digest"),
                F.concat("segments", F.array(_segment(F.col("levels"), digit))).alias("segments"),
            ),
        )
        lower = met.select(*rest, F.explode(ways).alias("way")).select(*rest, "way.*", F.lit(step - 1).alias("up"))
        paths = stage(paths.filter(F.col("up") != step).unionByName(lower), "paths")
    return paths.drop("up")


def _arrive(paths: DataFrame, requests: DataFrame, store: DataFrame, kept: list[str]) -> DataFrame:
    """Each request (group, pos, kept...) with ``path``, all segments in reverse, lowest first,
    and the other columns of its row of ``paths``."""
    rest = [c for c in paths.columns if c not in ("at", "digest", "segments", "rounds", "group")]
    asked = requests.groupBy("group", F.shiftright("pos", BITS).alias("at")).agg(
        F.collect_list(F.struct((F.col("pos") % WIDTH).cast("int").alias("digit"), *kept)).alias("asked")
    )
    # Where a group is a single leaf its root is no record, even if another group has one there.
    levels = F.when((F.col("rounds") > 0) & F.col("levels").isNotNull(), F.col("levels")).otherwise(F.array().cast("array<array<string>>"))
    met = paths.join(asked, ["group", "at"]).join(store, "digest", "left").withColumn("levels", levels)
    levels = F.col("levels")
    ways = F.transform(
        "asked",
        lambda way: F.struct(
            *[way[c].alias(c) for c in kept],
            F.flatten(F.reverse(F.concat("segments", F.array(_segment(levels, way["digit"]))))).alias("path"),
        ),
    )
    return met.select("group", *rest, ways.alias("ways"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the children beside its way up lead to."""
    return F.aggregate(
        path,
        leaf,
        lambda node, beside: F.when(beside["digest"].isNull(), digest(node))
        .when(beside["left"], digest(beside["digest"], node))
        .otherwise(digest(node, beside["digest"])),
    )


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Each of ``requests`` (group, pos, shown, kept...) with subroot, root, ``path`` (left,
    digest) from leaf to root, and ``folded_root``, to which ``shown`` and the path lead.

    Requests for ranks that a group does not have are left out; repeated ones are answered
    each. A block of at most ``WIDTH`` leaves answers its requests in one row.
    """
    store, groups = manifest.store, manifest.groups
    start = manifest.root.select(
        F.lit("").alias("group"), F.lit(0).cast("long").alias("at"), F.col("root").alias("digest"),
        F.array().cast(_SEGMENTS).alias("segments"), "root",
    )
    counted = groups.agg(F.max("groups"), F.max("leaves")).first()
    rounds = [max(0, -(-(int(n or 0) - 1).bit_length() // BITS)) if n else 0 for n in counted]

    ends = groups.select("group", "subroot", "pos", "leaves")
    asked = ends.join(requests.select("group").distinct(), "group", "left_semi")
    places = asked.select(F.lit("").alias("group"), "pos", F.lit(rounds[0]).alias("rounds"))
    top = _descend(start.withColumn("rounds", F.lit(rounds[0])), places, store, rounds[0])
    tops = asked.select(F.lit("").alias("group"), "pos", F.col("group").alias("own"), "subroot", "leaves")
    reached = _arrive(top, tops, store, ["own", "subroot", "leaves"]).select("root", F.explode("ways").alias("way"))
    paths = reached.select(
        F.col("way.own").alias("group"), F.lit(0).cast("long").alias("at"), F.col("way.subroot").alias("digest"),
        F.array("way.path").cast(_SEGMENTS).alias("segments"), "root", "way.subroot", _rounds(F.col("way.leaves")).alias("rounds"),
    )
    paths = stage(paths, "paths")
    places = requests.join(groups.select("group", "leaves"), "group").filter("pos >= 0 and pos < leaves")
    kept = [c for c in requests.columns if c not in ("group", "pos")]
    low = _descend(paths, places.select("group", "pos", _rounds(F.col("leaves")).alias("rounds")), store, rounds[1])
    met = _arrive(low, places.select("group", "pos", *kept), store, kept)
    done = F.transform(
        "ways", lambda way: F.struct(*[way[c].alias(c) for c in kept], way["path"].alias("path"), folded(way["shown"], way["path"]).alias("folded_root"))
    )
    return met.select("group", "subroot", "root", F.explode(done).alias("done")).select("group", "subroot", "root", "done.*")


def proof_digest(path: Column) -> Column:
    """The digest of a path's children, lowest first."""
    return F.sha2(F.array_join(F.transform(path, lambda beside: beside["digest"]), ""), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(group, key, digest, shown): every document's leaf, and the one recomputed after the
    tampering: where 7 divides the CRC-32 of the decimal doc_id, n_chars is one more.

    A null n_chars or doc_id is never tampered with. Groups are langs. Other columns of
    ``docs`` are not read.
    """
    fields = [F.col(name) for name in FIELDS]
    more = [F.col(name) + 1 if name == "n_chars" else F.col(name) for name in FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        group_key(F.col("lang")).alias("group"), F.col("doc_id").alias("key"), leaf_of(*fields).alias("digest"),
        F.when(hit, leaf_of(*more)).alias("changed"),
    )


def audit(docs: DataFrame) -> DataFrame:
    """Every document's proof, and whether its tampered or original leaf leads to the root."""
    manifest = build(document_leaves(docs))
    asked = manifest.leaves.select(
        "group", "pos", F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), F.coalesce("changed", "digest").alias("shown")
    )
    proved = prove(manifest, asked)
    return proved.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof through its lang's subroot, and the audit's verdict."""
    return audit(read(spark, sf_dir, "documents").select(*FIELDS))


# DuckDB has no CRC-32: its table comes from the polynomial, a text's value from its bytes.
SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, s: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
  FROM range(256) r(i)
), docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, lang, source, n_chars, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS hit
  FROM documents, crc_table
), parts AS (
  SELECT doc_id, grp, hit,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM docs
), hashed AS (
  SELECT doc_id, grp, hit, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS changed
  FROM parts
), leaves AS (
  SELECT doc_id, grp, leaf, CASE WHEN hit THEN changed ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n
  FROM hashed
), low AS (
  SELECT grp, 0 AS level, pos, leaf AS node, n FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2
  FROM low WHERE n > 1 GROUP BY grp, level, pos // 2, n
), subs AS (
  SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, pos, node, n FROM subs
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2
  FROM high WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
  SELECT l.grp, l.pos AS leaf_pos, x.level, (l.pos >> x.level) % 2 = 1 AS is_left, b.node AS beside
  FROM leaves l JOIN (SELECT DISTINCT grp, level FROM low WHERE n > 1) x USING (grp)
  LEFT JOIN low b ON b.grp = l.grp AND b.level = x.level AND b.pos = xor(l.pos >> x.level, 1)
  UNION ALL
  SELECT l.grp, l.pos, 100 + x.level, (s.pos >> x.level) % 2 = 1, b.node
  FROM leaves l JOIN subs s USING (grp) CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) x
  LEFT JOIN high b ON b.level = x.level AND b.pos = xor(s.pos >> x.level, 1)
), paths AS (
  SELECT grp, leaf_pos, list({'is_left': is_left, 'beside': beside} ORDER BY level) AS path,
         coalesce(string_agg(beside, '' ORDER BY level), '') AS joined
  FROM steps GROUP BY grp, leaf_pos
), ends AS (
  SELECT l.doc_id, l.leaf, s.node AS subroot, (SELECT node FROM high WHERE n = 1) AS root, coalesce(p.joined, '') AS joined,
         list_reduce(list_prepend({'is_left': false, 'beside': l.shown}, coalesce(p.path, [])),
           lambda a, b: {'is_left': false, 'beside': sha256(CASE WHEN b.is_left THEN coalesce(b.beside, '') || a.beside ELSE a.beside || coalesce(b.beside, '') END)}).beside AS folded_root
  FROM leaves l JOIN subs s USING (grp) LEFT JOIN paths p ON p.grp = l.grp AND p.leaf_pos = l.pos
)
SELECT doc_id, leaf, subroot, root, sha256(joined) AS proof_sha256, folded_root, folded_root = root AS verified FROM ends
"""

QUERIES = {"op11_merkle": op11_merkle}
ORACLES = {"op11_merkle": SQL}
