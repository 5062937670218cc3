"""Sums of products over every two items of a user, without shuffling the products.

On a sparse log over a large catalogue nearly every product is a pair of its own, so a sum by
pair shuffles about a row for each product, and the sums before the shuffle spill. Here the
items are dealt to tiles and a task holds the entries of two tiles, or of one: it meets the
items of each user, a bounded number of products at a time, and only the sums leave it. The
shuffle carries each entry once a tile (:func:`cell_sums`).

As tiles hold a bounded number of entries, they grow with the log, and most users have items in
few of many tiles. Then a task holds one tile and the entries that its users have in half of the
others (:func:`list_sums`): an entry is sent at most once for every other item of its user,
however many tiles there are, packed with the others of its tile.

Products are added up as whole multiples of 2**-62, as in :func:`exact_unit_sum`, so the bits
are those of a sum by Spark, however the items are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators.blocked import _pack, _pieces, _unpack

_UNIT = 2.0**62
# Products in memory at once, and rows of a batch that leaves a task.
_PRODUCTS, _ROWS = 1 << 21, 1 << 18

_Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _cells(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Entries, _Entries | None]]:
    """Both sides (uid, aid, w) of each cell of a partition, which holds one as a rule; a cell
    of one tile has no other side."""
    parts = [[column.to_numpy(zero_copy_only=False).copy() for column in batch.columns] for batch in stream]
    if not parts:
        return
    slot, *entries = (np.concatenate(columns) for columns in zip(*parts))
    del parts
    for cell in np.unique(slot // 3):
        sides = [tuple(column[slot == cell * 3 + side] for column in entries) for side in range(3)]
        if len(sides[0][0]):
            yield sides[0], None
        elif len(sides[1][0]) and len(sides[2][0]):
            yield sides[1], sides[2]


def _met(left: _Entries, right: _Entries | None) -> tuple[np.ndarray, ...]:
    """(aid, w, start, count, near, v): the left entries by item, and for each where the right
    entries (near, v) that it meets begin, and how many they are. Within one tile an entry
    meets its user's entries of larger items."""
    uid, near, v = left if right is None else right
    order = np.lexsort((near, uid))
    uid, near, v = uid[order], near[order], v[order]
    ends = np.append(np.flatnonzero(uid[1:] != uid[:-1]) + 1, len(uid))
    if right is None:
        rows, aid, w = np.arange(len(uid)), near, v
        last = ends[np.searchsorted(ends, rows, side="right")]
        steps = np.append(np.flatnonzero((uid[1:] != uid[:-1]) | (near[1:] != near[:-1])) + 1, len(uid))
        start = steps[np.searchsorted(steps, rows, side="right")]
    else:
        users, starts = uid[ends - 1], np.concatenate([[0], ends[:-1]])
        at = np.minimum(np.searchsorted(users, left[0]), len(users) - 1)
        start, aid, w = starts[at], left[1], left[2]
        last = np.where(users[at] == left[0], ends[at], start)
    order = np.argsort(aid, kind="stable")
    return aid[order], w[order], start[order], (last - start)[order], near, v


def _sums(left: _Entries, right: _Entries | None, least: float | None) -> Iterator[pa.RecordBatch]:
    aid, w, start, count, near, v = _met(left, right)
    names, column = np.unique(near, return_inverse=True)
    first = np.concatenate([[True], aid[1:] != aid[:-1]])
    items, row = aid[first], np.cumsum(first) - 1
    steps = np.cumsum(count)
    at, held = 0, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    while at < len(aid):
        to = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + _PRODUCTS, side="right")))
        n = count[at:to]
        place = np.repeat(start[at:to] - (np.cumsum(n) - n), n)
        place += np.arange(len(place))
        key = np.repeat(row[at:to] * len(names), n)
        key += column[place]
        product = np.repeat(w[at:to], n)
        product *= v[place]
        if not np.isfinite(product).all():
            raise ArithmeticError("a product of two ratings is not a number")
        whole = np.rint(product * _UNIT).astype(np.int64)
        key, whole, product = (np.concatenate(x) for x in zip(held, (key, whole, product)))
        order = np.argsort(key)
        key = key[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if len(cuts):
            key, whole, product = key[cuts], np.add.reduceat(whole[order], cuts), np.add.reduceat(product[order], cuts)
        if (np.abs(product) >= 1.999).any():
            raise ArithmeticError("the products of two items add up to more than 1: ratings repeat")
        # The last item may go on in the next piece.
        done = len(key) if to == len(aid) or row[to] != row[to - 1] else int(np.searchsorted(key, row[to - 1] * len(names)))
        held = key[done:], whole[done:], product[done:]
        sim = whole[:done] / _UNIT
        kept = sim != 0 if least is None else sim >= least
        one, other, sim = items[key[:done][kept] // len(names)], names[key[:done][kept] % len(names)], sim[kept]
        pairs = np.minimum(one, other), np.maximum(one, other), sim
        for low in range(0, len(sim), _ROWS):
            yield pa.record_batch([pa.array(x[low : low + _ROWS]) for x in pairs], ["aid", "sim_aid", "sim"])
        at = to


def cell_sums(unit: DataFrame, tiles: int, least: float | None = None) -> DataFrame:
    """(aid, sim_aid, sim), ``aid < sim_aid``: the sums over common users of the products of
    ``w`` in ``unit`` (uid, aid, w), those other than 0 or, if given, from ``least`` on.

    Ids are whole numbers. A task holds the entries of two of the ``tiles``.
    """
    kind = unit.schema["aid"].dataType
    tile, other = F.pmod(F.xxhash64("aid"), F.lit(tiles)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    dealt = unit.where(F.col("uid").isNotNull()).select(
        F.col("uid").cast("long").alias("uid"), F.col("aid").cast("long").alias("aid"), "w", tile.alias("tile"), other.alias("other")
    )
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    # A cell has three slots: the entries of its one tile, or of the first and the second of two.
    side = F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2)
    cell = (high * (high + 1) / 2 + low).cast("int")
    slots = dealt.select((cell * 3 + side).alias("slot"), "uid", "aid", "w")
    cells = slots.repartitionById(tiles * (tiles + 1) // 2, F.floor(F.col("slot") / 3).cast("int"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _cells(stream):
            yield from _sums(left, right, least)

    sums = cells.mapInArrow(run, "aid long, sim_aid long, sim double")
    return sums.select(F.col("aid").cast(kind), F.col("sim_aid").cast(kind), "sim")


def _lists(stream: Iterator[pa.RecordBatch], tiles: int) -> Iterator[pa.RecordBatch]:
    """Rows (uid, aid, rating, square, tile), sorted by user, packed for each tile: on side 0 the
    entries of the tile, on side 1 what their users have in the ``tiles // 2`` tiles after it,
    round the end, so that of two tiles one gets the other's. ``tiles`` is odd."""
    for uid, aid, rating, square, tile in _pieces(stream, by_user=True):
        first = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]]))
        size = np.diff(np.append(first, len(uid)))
        owner = np.repeat(np.arange(len(first)), size)
        tile = tile.astype(np.int64)
        met_tile, met_user = np.divmod(np.unique(tile * len(first) + owner), len(first))
        columns, bare = (uid, aid, rating / np.sqrt(square)), (uid, aid, rating, square)
        # A rating and its item's sum of squares often take less than their quotient's digits.
        kind = int(len(_pack(*bare)) < len(_pack(*columns)))
        columns = bare if kind else columns
        steps = np.cumsum(size[met_user])
        at = 0
        while at < len(steps):
            to = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + _PRODUCTS, side="right")))
            n = size[met_user[at:to]]
            place = np.repeat(first[met_user[at:to]] - (np.cumsum(n) - n), n)
            place += np.arange(len(place))
            here = np.repeat(met_tile[at:to], n)
            apart = (tile[place] - here) % tiles
            for side, chosen in enumerate((apart == 0, (apart > 0) & (apart <= tiles // 2))):
                sent, of = place[chosen], here[chosen]
                cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else []
                for low, high in zip(cuts, cuts[1:]):
                    data = _pack(*(np.ascontiguousarray(column[sent[low:high]]) for column in columns))
                    values = (pa.array([int(of[low])], pa.int32()), [side], [kind], [high - low], pa.array([data], pa.binary()))
                    yield pa.record_batch([values[0], *(pa.array(x, pa.int32()) for x in values[1:4]), values[4]], _PACKED_NAMES)
            at = to


_PACKED_NAMES = ["tile", "side", "kind", "n", "data"]


def _listed(stream: Iterator[pa.RecordBatch], least: float | None) -> Iterator[pa.RecordBatch]:
    """The sums of each tile of a partition, which holds one as a rule."""
    held: dict[int, tuple[list, list]] = {}
    for batch in stream:
        for tile, side, kind, n, data in zip(*(column.to_pylist() for column in batch.columns)):
            uid, aid, *values = _unpack(data, n, "i8", "i8", *["f8"] * (1 + kind))
            w = values[0] / np.sqrt(values[1]) if kind else values[0]
            held.setdefault(tile, ([], []))[side].append((uid, aid, w))
    for tile in list(held):
        own, others = ([np.concatenate(x) for x in zip(*side)] for side in held.pop(tile))
        yield from _sums(tuple(own), None, least)
        if others:
            yield from _sums(tuple(own), tuple(others), least)


def list_sums(unit: DataFrame, tiles: int, least: float | None = None) -> DataFrame:
    """The rows of :func:`cell_sums`, bit for bit. ``unit`` has ``rating`` and ``square``, whose
    root it is divided by, in place of ``w``. A task holds the entries of one of the ``tiles``, an
    odd number at least as large, and those that meet them."""
    kind, tiles = unit.schema["aid"].dataType, tiles | 1
    dealt = unit.where(F.col("uid").isNotNull()).select(
        F.col("uid").cast("long").alias("uid"), F.col("aid").cast("long").alias("aid"), F.col("rating").cast("double").alias("rating"),
        "square", F.pmod(F.xxhash64("aid"), F.lit(tiles)).cast("int").alias("tile"),
    )
    lists = dealt.repartition("uid").sortWithinPartitions("uid", "aid").mapInArrow(
        lambda stream: _lists(stream, tiles), "tile int, side int, kind int, n int, data binary"
    )
    sums = lists.repartitionById(tiles, F.col("tile")).mapInArrow(
        lambda stream: _listed(stream, least), "aid long, sim_aid long, sim double"
    )
    return sums.select(F.col("aid").cast(kind), F.col("sim_aid").cast(kind), "sim")
