"""Document quality by a generalised additive model with pairwise interactions.

Every feature is cut into bins at training quantiles. Boosting goes round the features: each
turn fits a tree of at most three leaves on one feature to what is left over and adds a
damped step to that feature's lookup table. The pairs of features that explain most of the
rest get two-dimensional tables in the same way, from trees of one cut on each axis. A score
is the sum of the table cells a document falls into, through the logistic function.

Features are counted over whole texts. The model is fitted on the driver from at most
``most_rows`` labelled rows (the least by hash of doc_id); its tables are a few kilobytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.common import Runs, batches, read, split_words, stage, typed

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_runs", "dup_lines", "words_per_line",
    "upper", "digits", "symbols", "bangs", "other_marks", "marks_per_word", "line_ends", "wide_bytes",
)
MOST_ROWS = 50_000
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 40, 0.1
THRESHOLD = 0.3
_CLASSES = ("upper", "digits", "symbols", "bangs", "other_marks", "wide_bytes")


def _byte_classes() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)
    for code in range(33, 127):
        char = chr(code)
        if char.isupper():
            table[code] = 0
        elif char.isdigit():
            table[code] = 1
        elif char in "#*$%&|<>":
            table[code] = 2
        elif char in "!?":
            table[code] = 3
        elif not char.isalpha() and char not in ".,":
            table[code] = 4
    table[128:] = 5
    return table


_CLASS_OF = _byte_classes()


def features(texts) -> np.ndarray:
    """One row of :data:`FEATURES` for every text (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    words = split_words(texts)
    owner = words.owner
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    kinds = _CLASS_OF[data]
    share = np.maximum(sizes, 1)
    out = np.zeros((n, len(FEATURES)))
    by_name = dict(zip(FEATURES, range(len(FEATURES))))

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    marks = np.zeros(n)
    for code, name in enumerate(_CLASSES):
        count = per_text(kinds == code)
        out[:, by_name[name]] = count / share
        if name in ("symbols", "bangs", "other_marks"):
            marks += count
    many = np.maximum(words.counts, 1)
    lines = per_text(data == 10) + 1
    distinct = np.zeros(n)
    if len(owner):
        order = np.lexsort((words.hashes, owner))
        a, b = owner[order], words.hashes[order]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        distinct = np.bincount(a, fresh, n)
    starts = np.flatnonzero(words.left >= 3)
    repeated = np.zeros(n)
    if len(starts):
        runs, run_owner = Runs(words.hashes).at(starts, 3), owner[starts]
        order = np.lexsort((runs, run_owner))
        a, b = run_owner[order], runs[order]
        again = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        repeated = np.bincount(a, again, n) / np.maximum(np.bincount(a, minlength=n), 1)
    out[:, by_name["log_words"]] = np.log1p(words.counts)
    out[:, by_name["word_length"]] = np.asarray(pc.utf8_length(texts)) / many
    out[:, by_name["distinct_words"]] = distinct / many
    out[:, by_name["repeated_runs"]] = repeated
    split = pc.split_pattern(texts, "\n")
    line_owner = np.repeat(np.arange(n), np.asarray(pc.list_value_length(split)))
    line = split.flatten().dictionary_encode()
    key = line_owner.astype(np.int64) << 32 | np.asarray(line.indices)
    out[:, by_name["dup_lines"]] = 1 - np.bincount(np.unique(key) >> 32, minlength=n) / lines if n else 0
    out[:, by_name["words_per_line"]] = words.counts / lines
    out[:, by_name["line_ends"]] = lines / many
    out[:, by_name["marks_per_word"]] = marks / many
    return out


def _steps(bins: np.ndarray, size: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with at most three leaves."""
    grad, hess = np.bincount(bins, g, size), np.bincount(bins, h, size)

    def cut(low: int, high: int):
        a, b = np.cumsum(grad[low:high]), np.cumsum(hess[low:high])
        if high - low < 2:
            return -np.inf, low
        gain = a[:-1] ** 2 / (b[:-1] + 1) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + 1) - a[-1] ** 2 / (b[-1] + 1)
        at = int(np.argmax(gain))
        return gain[at], low + at + 1

    _, first = cut(0, size)
    (left, at_left), (right, at_right) = cut(0, first), cut(first, size)
    edges = sorted({0, first, at_left if left > right else at_right, size})
    out = np.zeros(size)
    for a, b in zip(edges, edges[1:]):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1)
    return out


def _quarters(a: np.ndarray, b: np.ndarray, shape: tuple[int, int], g: np.ndarray, h: np.ndarray):
    """(gain, cell values) of the best tree with one cut on each of two features."""
    cell = a * shape[1] + b
    grad = np.bincount(cell, g, shape[0] * shape[1]).reshape(shape).cumsum(0).cumsum(1)
    hess = np.bincount(cell, h, shape[0] * shape[1]).reshape(shape).cumsum(0).cumsum(1)
    if min(shape) < 2:
        return -np.inf, np.zeros(shape)

    def four(x):
        inner, down, across, all_ = x[:-1, :-1], x[:-1, -1:], x[-1:, :-1], x[-1, -1]
        return [inner, down - inner, across - inner, all_ - down - across + inner]

    grads, hesses = four(grad), four(hess)
    gain = sum(x**2 / (y + 1) for x, y in zip(grads, hesses))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [x[i, j] / (y[i, j] + 1) for x, y in zip(grads, hesses)]
    out = np.empty(shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return gain[i, j], out


@dataclass
class Model:
    """Bin edges, a table for every feature, and tables for pairs."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (f, g), table in self.pairs.items():
            at = (np.searchsorted(self.coarse[k], x[:, k], side="right") for k in (f, g))
            total += table[tuple(at)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of the rows ``x`` with labels ``y`` (0 or 1); without rows it scores 0.5."""
    model = Model()
    if not len(y):
        return model
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(rate / (1 - rate)))

    def cuts(column: np.ndarray, size: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.arange(1, size) / size))

    model.edges = [cuts(x[:, f], BINS) for f in range(x.shape[1])]
    model.coarse = [cuts(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    fine = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, bins in enumerate(fine):
            step = RATE * _steps(bins, len(model.tables[f]), *slopes())
            model.tables[f] += step
            total += step[bins]
    shapes = [len(e) + 1 for e in model.coarse]
    g, h = slopes()
    gains = {(a, b): _quarters(rough[a], rough[b], (shapes[a], shapes[b]), g, h)[0] for a, b in combinations(range(x.shape[1]), 2)}
    chosen = sorted((p for p in gains if np.isfinite(gains[p])), key=lambda p: (-gains[p], p))[:PAIRS]
    model.pairs = {(a, b): np.zeros((shapes[a], shapes[b])) for a, b in chosen}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            step = RATE * _quarters(rough[a], rough[b], table.shape, *slopes())[1]
            table += step
            total += step[rough[a], rough[b]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept out of training; one without id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` as ``row``, with the array ``x`` of features."""
    return _per_text(docs, keep, "x array<double>", _listed)


def _listed(x: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))


def _per_text(docs: DataFrame, keep: tuple[str, ...], column: str, make: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """``keep`` as ``row``, and a column made from the features of each text."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text"))
    kind = rows.schema["row"].dataType
    name = column.split()[0]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1000):
            yield pa.record_batch([batch.column("row"), make(features(batch.column("text")))], ["row", name])

    return rows.mapInArrow(run, typed(row=kind, after=column))


def train(features_of: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """The model fitted on the labelled rows that are not :func:`held_out`.

    Rows of ``labels`` without doc_id or with a quality other than 0 and 1 are left out; of
    several labels of a document the least counts.
    """
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id")))
    rows = features_of.select(F.col("row.doc_id").alias("doc_id"), "x").join(known, "doc_id")
    order = F.xxhash64("doc_id")
    table = rows.orderBy(order, "doc_id", "x").limit(most_rows).select("x", "quality").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(x, table.column("quality").to_numpy().astype(float))


def scored(features_of: DataFrame, model: Model) -> DataFrame:
    """``row`` with its ``score`` and ``predicted`` (1 from :data:`THRESHOLD` on)."""
    shared = features_of.sparkSession.sparkContext.broadcast(model)
    kind = features_of.schema["row"].dataType

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column("row"), pa.array(shared.value.score(x))], ["row", "score"])

    scores = features_of.mapInArrow(run, typed(row=kind, after="score double"))
    return scores.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good; all columns as they were."""
    model = train(with_features(docs, "doc_id"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scores = _per_text(docs, tuple(docs.columns), "score double", lambda x: pa.array(shared.value.score(x)))
    return scores.filter(F.col("score") >= THRESHOLD).select("row.*")


def op8_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stage(with_features(docs, "doc_id"), "features")
    model = train(rows, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored(rows, model).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted"
    )


QUERIES = {"op8_gam": op8_gam}
ORACLES = {}
