"""Document fingerprints of closed syncmers.

A run of K bytes is an anchor if the least of its inner runs of S bytes, by hash, stands at
either end of it. Whether a run is an anchor depends on its own bytes only, so an edit
leaves all anchors away from it as they were, and any K - S runs in a row hold one. A
fingerprint is all anchors of the whole text in the order of their places. Two anchors in a
row and the distance between them make a link; two fingerprints are alike by the links they
share, each as often as both have it. A link says where its anchors stand to each other and
nothing of the rest, so passages match wherever they stand and whatever comes between them.
"""

from __future__ import annotations

import base64
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.llm.common import by_hash, chunked, mix, ordered, read, release, typed

K, S = 16, 5
TEXTS = 500
_ANCHOR = np.dtype([("gap", "u1"), ("hash", ">u4")])
_BLOCK = 1 << 19
_OWNER_BITS = 10


class Prints(NamedTuple):
    """Anchors of some texts, one text after another: those of text i stand at
    ``starts[i]`` to ``starts[i + 1]``, by rising place."""

    starts: np.ndarray
    hashes: np.ndarray
    places: np.ndarray

    def rows(self, first: int, last: int) -> Prints:
        """The fingerprints of the texts from ``first`` up to ``last``."""
        low, high = self.starts[first], self.starts[last]
        return Prints(self.starts[first : last + 1] - low, self.hashes[low:high], self.places[low:high])


def _packed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of S and of 8 bytes from each place on, as integers; data ends in K zeros."""
    one = data.astype(np.uint64)
    two = one[:-1] << np.uint64(8) | one[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    return four[:-1] << np.uint64(8) | one[4:], four[:-4] << np.uint64(32) | four[4:]


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all closed syncmers of ``data``, which K zeros follow."""
    n = len(data) - K
    short, eight = _packed(data)
    order = mix(short)
    span = K - S + 1
    least, width = order, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    gap = span - width
    least = np.minimum(least[: len(least) - gap], least[gap:])[:n]
    places = np.flatnonzero((order[:n] == least) | (order[span - 1 : span - 1 + n] == least))
    return places, mix(eight[places] ^ mix(eight[places + 8]))


def fingerprints(texts: list[bytes]) -> Prints:
    """All anchors of each text. A text without one, as a short one, is one anchor as a
    whole; an empty text has none."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts) + b"\0" * K, np.uint8)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at in range(0, len(data) - K, _BLOCK):
        place, value = _anchors(data[at : min(at + _BLOCK, len(data) - K) + K])
        places.append(place + at)
        hashes.append(value >> np.uint64(32))
    place, value = np.concatenate(places), np.concatenate(hashes)
    owner = np.searchsorted(ends, place, side="right")
    fits = place + K <= ends[owner] if n else place > 0
    owner, place, value = owner[fits], place[fits], value[fits]
    bare = np.flatnonzero((np.bincount(owner, minlength=n) == 0) & (sizes > 0))
    digest = [int.from_bytes(hashlib.sha256(texts[i]).digest()[:4], "big") for i in bare]
    at = np.searchsorted(owner, bare)
    owner, value = np.insert(owner, at, bare), np.insert(value, at, np.array(digest, np.uint64))
    place = np.insert(place, at, (ends - sizes)[bare])
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)
    return Prints(starts, value, place - (ends - sizes)[owner] if n else place)


def _links(prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """(owner, link) of every two anchors in a row; a single anchor is a link by itself."""
    n = np.diff(prints.starts)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero(owner[1:] == owner[:-1])
    gap = (prints.places[first + 1] - prints.places[first]).astype(np.uint64)
    pair = mix(prints.hashes[first] << np.uint64(32) | prints.hashes[first + 1])
    alone = prints.starts[:-1][n == 1]
    links = np.concatenate([mix(pair ^ gap), mix(prints.hashes[alone])])
    return np.concatenate([owner[first], owner[alone]]), links


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Twice the shared links over all links of both, row by row; 1 for two empty
    fingerprints."""
    n = len(a.starts) - 1
    if n > 1 << _OWNER_BITS:
        half = n // 2
        return np.concatenate([
            likeness(a.rows(*part), b.rows(*part)) for part in ((0, half), (half, n))
        ])
    keys, total = [], np.zeros(n)
    for prints in (a, b):
        owner, link = _links(prints)
        total += np.bincount(owner, minlength=n)
        key = owner.astype(np.uint64) << np.uint64(64 - _OWNER_BITS) | link >> np.uint64(_OWNER_BITS)
        keys.append(by_hash(key))
    (left, often), (right, times) = keys
    at = np.minimum(np.searchsorted(right, left), max(0, len(right) - 1))
    hit = right[at] == left if len(right) else np.zeros(len(left), bool)
    owner = (left[hit] >> np.uint64(64 - _OWNER_BITS)).astype(np.int64)
    shared = np.bincount(owner, np.minimum(often[hit], times[at[hit]]), n)
    return np.where(total == 0, 1.0, 2 * shared / np.maximum(total, 1))


def text_form(prints: Prints) -> list[str]:
    """Fingerprints as text: base64 of a byte of distance from the anchor before (the first:
    from the start), then 4 of hash, for each anchor. Distances are at most K - S."""
    gaps = np.diff(prints.places, prepend=0)
    first = prints.starts[:-1][np.diff(prints.starts) > 0]
    gaps[first] = prints.places[first]
    cells = np.zeros(len(gaps), _ANCHOR)
    cells["gap"], cells["hash"] = gaps, prints.hashes
    data, ends = cells.tobytes(), prints.starts * _ANCHOR.itemsize
    return [base64.b64encode(data[low:high]).decode() for low, high in zip(ends, ends[1:])]


def from_text(forms: list[str]) -> Prints:
    """The fingerprints that :func:`text_form` wrote."""
    data = [base64.b64decode(form) for form in forms]
    cells = np.frombuffer(b"".join(data), _ANCHOR)
    starts = np.concatenate([[0], np.cumsum([len(d) // _ANCHOR.itemsize for d in data])]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(cells["gap"].astype(np.int64))])
    places = sums[1:] - np.repeat(sums[starts[:-1]], np.diff(starts))
    return Prints(starts, cells["hash"].astype(np.uint64), places)


_FIELDS = {
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}
_SCHEMA = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _compare(texts: list[str], nexts: list[str], chained: bool = False) -> dict[str, pa.Array]:
    """The fingerprint columns of texts, each with the one that follows it; ``chained`` if
    each is the one that follows the text after it in the list."""
    cuts = [len(t) // 3 for t in texts]
    edited = [(t[: len(t) - c] + x[:c]).encode() for t, x, c in zip(texts, nexts, cuts)]
    columns: dict[str, list] = {name: [] for name in _FIELDS}
    for at in range(0, len(texts), TEXTS):
        part = slice(at, at + TEXTS)
        other = fingerprints(edited[part])
        if chained:
            both = fingerprints([t.encode() for t in nexts[at : at + 1] + texts[part]])
            n = len(both.starts) - 1
            own, after = both.rows(1, n), both.rows(0, n - 1)
        else:
            own = fingerprints([t.encode() for t in texts[part]])
            after = fingerprints([t.encode() for t in nexts[part]])
        columns["fingerprint"] += text_form(own)
        columns["edited_fingerprint"] += text_form(other)
        columns["near_edited"] += likeness(own, other).tolist()
        columns["near_next"] += likeness(own, after).tolist()
    columns["n_chars"] = [len(t) for t in texts]
    columns["edited_sha256"] = [hashlib.sha256(t).hexdigest() for t in edited]
    return {name: pa.array(columns[name], kind) for name, kind in _FIELDS.items()}


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (as ``row``), of its text edited with the next
    row's, and how like they are. The next row is that of the next smaller doc_id; after the
    smallest comes the largest. Rows of equal doc_id are ordered by text, a null doc_id
    comes last, a null text counts as empty, a single row is its own next.
    """
    rows, _ = chunked(docs)
    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType

    def texts(table):
        return pc.fill_null(pc.struct_field(table.column("row"), "text"), "").to_pylist()

    def inner(key, table):
        release()
        table = ordered(table)
        own = texts(table)
        columns = _compare(own[1:], own[:-1], chained=True)
        return pa.table({"row": table.column("row").slice(1), **columns})

    def edges(key, table):
        table = ordered(table)
        own = texts(table)
        return pa.table({
            "chunk": table.column("chunk").slice(0, 1),
            "row": table.column("row").slice(0, 1),
            "last": pa.array(own[-1:], pa.string()),
        })

    def outer(stream):
        for batch in stream:
            row = batch.column("row")
            own = pc.fill_null(pc.struct_field(row, "text"), "").to_pylist()
            columns = _compare(own, batch.column("last").to_pylist())
            yield pa.record_batch([row, *columns.values()], ["row", *columns])

    schema = typed(row=kind, after=_SCHEMA)
    ends = rows.groupBy("chunk").applyInArrow(edges, typed("chunk long", "last string", row=kind))
    # One number for each chunk; the first chunk follows on from the last.
    chunks = rows.select("chunk").distinct()
    order = Window.orderBy("chunk")
    follows = chunks.select(
        "chunk",
        F.coalesce(
            F.lag("chunk").over(order),
            F.max("chunk").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("before"),
    )
    seams = (
        ends.select("chunk", "row")
        .join(follows, "chunk")
        .join(ends.select(F.col("chunk").alias("before"), "last"), "before")
        .select("row", "last")
    )
    return rows.groupBy("chunk").applyInArrow(inner, schema).unionByName(seams.mapInArrow(outer, schema))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like they are."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_neighbours(docs).select("row.doc_id", *_FIELDS)


QUERIES = {"op6_syncmers": op6_syncmers}
ORACLES = {}
