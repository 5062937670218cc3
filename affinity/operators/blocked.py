"""Top-k of a sparse product in blocks: each user's best unseen items over a large catalogue.

The score of a user and an item is the similarity-weighted mean of the user's ratings, so it
takes two sums over the user's items, for every item near one of them. Summed by a join and
an aggregate, nearly every user meets nearly every item in the shuffle before k of them are
kept. Here the items are dealt to tiles and the users to blocks. A task holds one tile of
the similarities, and the ratings of one block go by it, a few users at a time: the two sums
of the items they meet in the tile are taken, seen items are masked, and only the k best of
the tile leave the task. As no task holds its block, blocks are few: the shuffle carries each
similarity once a block, each rating once a tile, both packed by the thousand, and k rows a
user and tile.

A user's items are added up in the order of their ids, in one task, so equal inputs give
equal bits however tiles and blocks are cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Similarities that a task holds, and ratings that go by them.
ENTRIES_PER_TILE = 24_000_000
RATINGS_PER_BLOCK = 64_000_000
# Products in memory at once, and places for sums.
_PRODUCTS, _SUMS = 1 << 21, 1 << 23
# Rows that are packed together.
_PACKED = 1 << 17
_SIMILARITY, _RATING = 0, 1
_CODEC = "zstd"
_ROW = "slot int, n int, data binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 8 bytes a value as bytes: equal places of the values lie together."""
    planes = [column.view(np.uint8).reshape(-1, 8).T.tobytes() for column in columns]
    return pa.compress(b"".join(planes), codec=_CODEC, asbytes=True)


def _unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    """The columns of :func:`_pack`, of ``n`` values and the types ``kinds``."""
    raw = pa.decompress(data, decompressed_size=8 * n * len(kinds), codec=_CODEC, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(len(kinds), 8, n)
    return [np.ascontiguousarray(plane.T).view(kind).ravel() for plane, kind in zip(planes, kinds)]


def _narrow(ids: np.ndarray) -> np.ndarray:
    """``ids`` in 4 bytes where they fit."""
    small = np.iinfo(np.int32)
    return ids.astype(np.int32) if len(ids) and small.min <= ids.min() and ids.max() <= small.max else ids


def _dealt(value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")


class _Tile:
    """The similarities of one tile, sorted by item: for each, its neighbours in the tile."""

    def __init__(self, item: np.ndarray, near: np.ndarray, sim: np.ndarray):
        self.columns = np.unique(near)
        self.column, self.sim = np.searchsorted(self.columns, near).astype(np.int32), sim
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        self.items, self.bounds = item[first], np.append(first, len(item))

    def rows(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where an item's neighbours begin, and how many there are."""
        at = np.minimum(np.searchsorted(self.items, item), len(self.items) - 1)
        known = self.items[at] == item
        return np.where(known, self.bounds[at], 0), np.where(known, self.bounds[at + 1] - self.bounds[at], 0)

    def best(self, uid: np.ndarray, item: np.ndarray, rating: np.ndarray, k: int, digits: int | None):
        """(uid, item, score) of the k best unseen items of each user; rows sorted by both."""
        users, owner = np.unique(uid, return_inverse=True)
        width = len(self.columns)
        start, count = self.rows(item)
        steps = np.cumsum(count)
        cuts = [0]
        while cuts[-1] < len(item):
            at = cuts[-1]
            cuts.append(max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + _PRODUCTS, side="right"))))

        def products(at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
            """Where the similarities of some ratings lie, and the cells they add to."""
            n = count[at:to]
            place = np.repeat(start[at:to] - (np.cumsum(n) - n), n)
            place += np.arange(len(place))
            cell = np.repeat(owner[at:to] * width, n)
            cell += self.column[place]
            return place, cell

        pieces = list(zip(cuts, cuts[1:]))
        only = products(*pieces[0]) if len(pieces) == 1 else None
        # Most cells of many users and items get no product: sums are kept for the others.
        met = np.zeros(len(users) * width, bool)
        for piece in pieces:
            met[(only or products(*piece))[1]] = True
        cells = np.flatnonzero(met)
        at_sum = np.empty(len(met), np.int32)
        at_sum[cells] = np.arange(len(cells), dtype=np.int32)
        weighted, weight = np.zeros(len(cells)), np.zeros(len(cells))
        for at, to in pieces:
            place, cell = only or products(at, to)
            target, sim = at_sum[cell], self.sim[place]
            weight += np.bincount(target, sim, len(cells))
            sim *= np.repeat(rating[at:to], count[at:to])
            weighted += np.bincount(target, sim, len(cells))
        score = np.divide(weighted, weight, out=np.full(len(cells), -np.inf), where=weight != 0)
        key = -(score if digits is None else np.floor(score * 10.0**digits + 0.5))
        key[np.isinf(key)] = np.finfo(float).max
        seen = np.searchsorted(self.columns, item)
        inside = seen < width
        inside[inside] = self.columns[seen[inside]] == item[inside]
        masked = owner[inside] * width + seen[inside]
        key[at_sum[masked[met[masked]]]] = np.inf
        row, column = np.divmod(cells, width)
        sizes = np.bincount(row, minlength=len(users))
        least = np.full(len(users), np.inf)
        if sizes.max() > k:
            each = np.full((len(users), sizes.max()), np.inf)
            each[row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]] = key
            least = np.partition(each, k - 1, axis=1)[:, k - 1]
        few = np.flatnonzero((key <= least[row]) & (key < np.inf))
        # Equal keys stay in the order of the items; beyond k of a user they go.
        few = few[np.lexsort((key[few], row[few]))]
        few = few[np.arange(len(few)) - np.searchsorted(row[few], row[few]) < k]
        return users[row[few]], self.columns[column[few]], score[few]


def _chunks(uid: np.ndarray, count: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole users with at most so many products and sums; one user at least."""
    first = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]]))
    ends = np.append(first[1:], len(uid))
    done = np.concatenate([[0], np.cumsum(count)])
    most = max(1, _SUMS // max(1, width))
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(done[ends], done[first[at]] + _PRODUCTS, side="right")))
        to = min(to, at + most, len(first))
        yield int(first[at]), int(ends[to - 1])
        at = to


def _packed_entries(stream: Iterator[pa.RecordBatch], blocks: int, tiles: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, v, tile_a, tile_b) of similarities, packed by tile in both directions."""
    for a, b, v, tile_a, tile_b in _pieces(stream):
        item, near, sim, tile = np.append(a, b), np.append(b, a), np.append(v, v), np.append(tile_b, tile_a)
        order = np.argsort(tile, kind="stable")
        item, near, sim, tile = item[order], near[order], sim[order], tile[order]
        cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
        for low, high in zip(cuts, cuts[1:]):
            data = _pack(item[low:high], near[low:high], sim[low:high])
            slots = [2 * (block * tiles + int(tile[low])) + _SIMILARITY for block in range(blocks)]
            yield _row(slots, high - low, data)


def _packed_users(stream: Iterator[pa.RecordBatch], blocks: int, tiles: int) -> Iterator[pa.RecordBatch]:
    """Rows (uid, aid, rating, block) of ratings, sorted by block, user and item, packed by
    whole users for each tile."""
    for uid, aid, rating, block in _pieces(stream, by_user=True):
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        for low, high in zip(cuts, cuts[1:]):
            data = _pack(uid[low:high], aid[low:high], rating[low:high])
            first = int(block[low]) * tiles
            for tile in range(0, tiles, 32):
                slots = [2 * (first + x) + _RATING for x in range(tile, min(tile + 32, tiles))]
                yield _row(slots, high - low, data)


def _row(slots: list[int], n: int, data: bytes) -> pa.RecordBatch:
    columns = [pa.array(slots, pa.int32()), pa.array([n] * len(slots), pa.int32()), pa.array([data] * len(slots), pa.binary())]
    return pa.record_batch(columns, ["slot", "n", "data"])


def _pieces(stream: Iterator[pa.RecordBatch], by_user: bool = False) -> Iterator[list[np.ndarray]]:
    """The columns of many rows at a time; where the first holds users, a piece may have to end
    with one of them."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in stream:
        held.append([column.to_numpy(zero_copy_only=False) for column in batch.columns])
        n += batch.num_rows
        if n < _PACKED:
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        end = n
        if by_user:
            others = np.flatnonzero(columns[0] != columns[0][-1])
            end = int(others[-1]) + 1 if len(others) else 0
        if end:
            yield [column[:end] for column in columns]
        held, n = [[column[end:] for column in columns]], n - end
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def _scored(stream: Iterator[pa.RecordBatch], k: int, digits: int | None) -> Iterator[pa.RecordBatch]:
    """The candidates of each cell from its rows (slot, n, data), sorted by slot: first the
    similarities, which are held, then the ratings, which are not."""
    cell, held, tile = None, [], None
    for batch in stream:
        for slot, n, data in zip(*(column.to_pylist() for column in batch.columns)):
            if slot // 2 != cell:
                cell, held, tile = slot // 2, [], None
            if slot % 2 == _SIMILARITY:
                item, near, sim = _unpack(data, n, "i8", "i8", "f8")
                held.append((_narrow(item), _narrow(near), sim))
                continue
            if tile is None and not held:
                continue
            if tile is None:
                tile, held = _tile(held), []
            uid, rated, rating = _unpack(data, n, "i8", "i8", "f8")
            for low, high in _chunks(uid, tile.rows(rated)[1], len(tile.columns)):
                users, items, score = tile.best(uid[low:high], rated[low:high], rating[low:high], k, digits)
                columns = [pa.array(users), pa.array(items.astype(np.int64)), pa.array(score, mask=np.isinf(score))]
                yield pa.record_batch(columns, ["uid", "sim_aid", "pred_rating"])


def _tile(held: list[tuple[np.ndarray, ...]]) -> _Tile:
    item = np.concatenate([x[0] for x in held])
    order = np.argsort(item, kind="stable")
    return _Tile(item[order], np.concatenate([x[1] for x in held])[order], np.concatenate([x[2] for x in held])[order])


def tile_candidates(
    ratings: DataFrame,
    similarity: DataFrame,
    k: int,
    digits: int | None = None,
    entries_per_tile: int = ENTRIES_PER_TILE,
    ratings_per_block: int = RATINGS_PER_BLOCK,
) -> DataFrame:
    """(uid, sim_aid, pred_rating): of each user and tile the k best items without a rating.

    ``similarity`` (aid, sim_aid, sim) holds each pair once, in either order. Items rank by
    their score, rounded to ``digits`` if given, then by id; a score whose weights add up to
    0 is null and ranks last. Pass staged tables: they are counted first.
    """
    spark = ratings.sparkSession
    rated, near = ratings.count(), 2 * similarity.count()
    blocks = max(1, math.ceil(rated / ratings_per_block))
    cores = spark.sparkContext.defaultParallelism
    tiles = max(1, math.ceil(near / entries_per_tile), min(math.ceil(cores / blocks), math.ceil(near / 100_000)))
    # Cell block * tiles + tile has two slots, first its similarities, then its ratings.
    pairs = similarity.select(
        F.col("aid").cast("long").alias("a"), F.col("sim_aid").cast("long").alias("b"), F.col("sim").cast("double").alias("v"),
        _dealt(F.col("aid"), tiles).alias("tile_a"), _dealt(F.col("sim_aid"), tiles).alias("tile_b"),
    )
    users = ratings.select(
        F.col("uid").cast("long").alias("a"), F.col("aid").cast("long").alias("b"), F.col("rating").cast("double").alias("v"),
        _dealt(F.col("uid"), blocks).alias("block"),
    )
    left = pairs.mapInArrow(lambda stream: _packed_entries(stream, blocks, tiles), _ROW)
    dealt = users.repartition("a").sortWithinPartitions("block", "a", "b")
    right = dealt.mapInArrow(lambda stream: _packed_users(stream, blocks, tiles), _ROW)
    cells = left.unionByName(right).repartitionById(blocks * tiles, F.floor(F.col("slot") / 2).cast("int")).sortWithinPartitions("slot")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scored(stream, k, digits)

    return cells.mapInArrow(run, "uid long, sim_aid long, pred_rating double")
