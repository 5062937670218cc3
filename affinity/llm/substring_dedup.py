"""Removal of repeated passages by hashed windows of words, dealt by prefixes.

No suffix tree is built: every suffix of every document that has ``window`` words left is
cut at that depth and stands for the hash of these words. Suffixes are dealt to groups by a
prefix of one word; a prefix that holds more suffixes than ``group_size`` is lengthened
(2, 4, 8, ... words) until its groups fit in memory. The prefixes to lengthen are found by
counting, shortest first. In a group the hashes are sorted; of equal ones all but the first
in text order are marked. Marks that overlap join to one passage, however deep its repeat is.

A prefix of the full depth with more than ``group_size`` suffixes is one window. It
needs no group: its first place is a minimum, aggregated before the shuffle.

Suffixes travel as packed 64-bit labels, one row for each group and chunk of documents,
in text order, and come back as one bit each, so no document is shuffled more than once.
Two different windows count as equal only if both label and group agree by accident:
fewer than one pair is expected among some billions of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.common import Runs, Words, batches, by_hash, chunked, found, mix, ordered, read, release, split_words, typed

WINDOW = 20
GROUP_SIZE = 1_000_000


def depths(window: int) -> list[int]:
    """Prefix lengths in the order they are tried."""
    return sorted({min(1 << i, window) for i in range(window.bit_length() + 1)})


def prefixes(words: Words, window: int, frequent: dict[int, np.ndarray]):
    """(starts, prefix, whole): the suffixes, the prefix each is dealt by, and whether a
    suffix is a frequent prefix of the full depth."""
    starts = np.flatnonzero(words.left >= window)
    runs = Runs(words.hashes)
    prefix = runs.at(starts, 1)
    longer = np.arange(len(starts))
    for depth, deeper in zip(depths(window), depths(window)[1:] + [None]):
        longer = longer[found(prefix[longer], frequent.get(depth, np.zeros(0, np.uint64)))]
        if deeper and len(longer):
            prefix[longer] = runs.at(starts[longer], deeper)
    whole = np.zeros(len(starts), bool)
    whole[longer] = True
    return starts, prefix, whole, runs


def long_prefixes(docs: DataFrame, window: int, group_size: int) -> dict[int, np.ndarray]:
    """By depth, the sorted prefixes with more than ``group_size`` suffixes.

    At most (words / group_size) of them exist at any depth.
    """
    frequent: dict[int, np.ndarray] = {}
    for depth, shorter in zip(depths(window), [None, *depths(window)]):

        def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(stream, 1500):
                words = split_words(batch.column("text"))
                starts = np.flatnonzero(words.left >= window)
                runs = Runs(words.hashes)
                if shorter:
                    _, prefix, _, _ = prefixes(words, window, {d: frequent[d] for d in frequent if d < shorter})
                    starts = starts[found(prefix, frequent[shorter])]
                values, counts = by_hash(runs.at(starts, depth))
                yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(counts)], ["prefix", "n"])

        rows = (
            docs.select("text")
            .mapInArrow(count, "prefix long, n long")
            .groupBy("prefix")
            .agg(F.sum("n").alias("n"))
            .filter(F.col("n") > group_size)
            .select("prefix")
            .collect()
        )
        if not rows:
            break
        frequent[depth] = np.sort(np.array([row[0] for row in rows], np.int64).view(np.uint64))
    return frequent


def _group(prefix: np.ndarray, groups: int) -> np.ndarray:
    return (mix(prefix) % np.uint64(groups)).astype(np.int64)


def first_leaves(rows: DataFrame, window: int, frequent: dict[int, np.ndarray]) -> dict[int, tuple[int, int]]:
    """(chunk, word number) of the first suffix under every frequent prefix of full depth."""
    if window not in frequent:
        return {}

    def first(key, table):
        words = split_words(pc.struct_field(ordered(table).column("row"), "text"))
        starts, prefix, whole, _ = prefixes(words, window, frequent)
        values, at = np.unique(prefix[whole], return_index=True)
        return pa.table({
            "prefix": pa.array(values.view(np.int64)),
            "chunk": pa.array(np.full(len(values), key[0].as_py(), np.int64)),
            "at": pa.array(starts[whole][at].astype(np.int64)),
        })

    got = rows.groupBy("chunk").applyInArrow(first, "prefix long, chunk long, at long")
    least = got.groupBy("prefix").agg(F.min(F.struct("chunk", "at")).alias("first"))
    return {row["prefix"]: tuple(row["first"]) for row in least.collect()}


def _spans(gone: np.ndarray, words: Words) -> pa.Array:
    """Runs of removed words as [start, end) within each text."""
    owner, starts = words.owner, words.starts
    fresh = np.ones(len(gone), bool)
    fresh[1:] = owner[1:] != owner[:-1]
    begins = np.flatnonzero(gone & (fresh | ~np.concatenate([[False], gone[:-1]])))
    last = np.concatenate([fresh[1:], [True]])[: len(gone)]
    ends = np.flatnonzero(gone & (last | ~np.concatenate([gone[1:], [False]]))) + 1
    base = starts[owner[begins]]
    pairs = np.column_stack([begins - base, ends - base]).astype(np.int64)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(pairs) + 1, 2, dtype=np.int32)), pa.array(pairs.ravel()))
    held = np.bincount(owner[begins], minlength=len(words.counts))
    outer = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(outer), inner)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, group_size: int = GROUP_SIZE
) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``n_words``, ``n_removed``, ``kept`` (text of the
    words left, joined by one space) and ``repeats`` (maximal repeats as [start, end) of words).

    A word goes if it is covered by a window of ``window`` words that also starts earlier:
    in a row with a smaller doc_id, or before in the same text. Null texts have no words; a
    null doc_id comes before all others; rows with equal doc_id are ordered by text, and of
    equal rows one keeps its text. An empty table gives an empty result.
    """
    rows, size = chunked(docs)
    frequent = long_prefixes(docs, window, group_size)
    first = first_leaves(rows, window, frequent)
    groups = max(1, -(-size // (6 * group_size)) * 2)

    def deal(key, table):
        release()
        words = split_words(pc.struct_field(ordered(table).column("row"), "text"))
        starts, prefix, whole, runs = prefixes(words, window, frequent)
        group = _group(prefix, groups)
        use = np.flatnonzero(~whole)
        order = use[np.argsort(group[use], kind="stable")]
        labels = runs.at(starts[order], window)
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
        ends = np.append(cuts[1:], len(order))
        packed = [labels[a:b].tobytes() for a, b in zip(cuts, ends)]
        return pa.table({
            "tree": pa.array(group[order][cuts]),
            "chunk": pa.array(np.full(len(cuts), key[0].as_py(), np.int64)),
            "labels": pa.array(packed, pa.binary()),
        })

    def repeated(table):
        release()
        table = table.sort_by("chunk")
        packed = [np.frombuffer(x, np.uint64) for x in table.column("labels").to_pylist()]
        labels = np.concatenate(packed)
        order = np.argsort(labels, kind="stable")
        leaves = labels[order]
        marks = np.zeros(len(labels), bool)
        marks[order[1:][leaves[1:] == leaves[:-1]]] = True
        ends = np.cumsum([len(x) for x in packed])
        bits = [np.packbits(part).tobytes() for part in np.split(marks, ends[:-1])]
        return table.select(["tree", "chunk"]).append_column("marks", pa.array(bits, pa.binary()))

    row_type = docs.select(F.struct("*").alias("row")).schema["row"].dataType

    def cut(key, left, right):
        release()
        table = ordered(left)
        words = split_words(pc.struct_field(table.column("row"), "text"))
        starts, prefix, whole, _ = prefixes(words, window, frequent)
        group = _group(prefix, groups)
        use = np.flatnonzero(~whole)
        order = use[np.argsort(group[use], kind="stable")]
        sizes = np.bincount(group[use], minlength=groups)
        marks = np.zeros(len(starts), bool)
        right = right.sort_by("tree")
        bits = [
            np.unpackbits(np.frombuffer(packed, np.uint8), count=int(sizes[tree]))
            for tree, packed in zip(right.column("tree").to_pylist(), right.column("marks").to_pylist())
        ]
        if bits:
            marks[order] = np.concatenate(bits)
        names, name = np.unique(prefix[whole].view(np.int64), return_inverse=True)
        leaves = np.array([first[int(x)] for x in names], np.int64).reshape(-1, 2)[name]
        marks[whole] = (leaves[:, 0] != key[0].as_py()) | (leaves[:, 1] != starts[whole])
        cover = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(cover, starts[marks], 1)
        np.add.at(cover, starts[marks] + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed = np.bincount(words.owner, weights=gone, minlength=len(words.counts)).astype(np.int64)
        kept = words.text.filter(pa.array(~gone))
        offsets = np.concatenate([[0], np.cumsum(words.counts - removed)])
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), kept)
        return pa.table({
            "row": table.column("row"),
            "n_words": pa.array(words.counts),
            "n_removed": pa.array(removed),
            "kept": pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()),
            "repeats": _spans(gone, words),
        })

    trees = rows.groupBy("chunk").applyInArrow(deal, "tree long, chunk long, labels binary")
    marks = trees.groupBy("tree").applyInArrow(repeated, "tree long, chunk long, marks binary")
    schema = typed(row=row_type, after="n_words long, n_removed long, kept string, repeats array<array<long>>")
    return rows.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(cut, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages of 20 words or more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES = {
    "op4_substring_dedup": f"""
        WITH spread AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place
            FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM documents)),
        windows AS (
            SELECT doc_id, place, list(word) OVER following AS run FROM spread
            WINDOW following AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
        ranked AS (
            SELECT doc_id, place, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, place) > 1 AS again
            FROM windows WHERE len(run) = {WINDOW}),
        covered AS (
            SELECT s.doc_id, s.place, s.word,
                coalesce(max(r.again) OVER (PARTITION BY s.doc_id ORDER BY s.place
                    ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), false) AS gone
            FROM spread s LEFT JOIN ranked r ON r.doc_id = s.doc_id AND r.place = s.place),
        cut AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS kept
            FROM covered GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
            sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN cut c ON c.doc_id = d.doc_id"""
}
