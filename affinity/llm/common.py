"""Helpers the operators share: word hashes in numpy, document chunks, staged tables.

Words are runs of ``[^\\x20\\x09-\\x0D]``. A word is known by a 64-bit hash of its
text, a run of words by a polynomial over those hashes.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from affinity.plans import staging

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  other C libraries have none
except (OSError, AttributeError):
    _LIBC = None
_MARKS = re.compile(r"[\W_]+")
SPACES = r"[\x20\x09-\x0D]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    return staging.stage(df, name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(parts, lambda word: word != "")


def typed(before: str = "", after: str = "", **fields: DataType) -> StructType:
    """A schema of the columns ``before``, then ``fields`` with their own types, then ``after``."""
    own = [StructField(name, kind) for name, kind in fields.items()]
    ends = [StructType.fromDDL(part).fields if part else [] for part in (before, after)]
    return StructType([*ends[0], *own, *ends[1]])


def shuffle_width(spark: SparkSession, size: int, per_task: int = 8 << 20) -> int:
    """Partitions for ``size`` bytes, and never fewer than the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_task))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted ``table``."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


@dataclass
class Words:
    """The words of some texts, one after another."""

    text: pa.Array
    hashes: np.ndarray
    counts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])

    @property
    def owner(self) -> np.ndarray:
        """The number of the text each word stands in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def left(self) -> np.ndarray:
        """How many words are left in the text at each word, itself included."""
        return np.repeat(self.starts[1:], self.counts) - np.arange(len(self.hashes))


def flat(array) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def split_words(texts, lower: bool = False, fold: bool = False) -> Words:
    """The words of an Arrow column of texts (null: none).

    ``fold`` hashes words in lower case without punctuation and leaves out those that have
    nothing else.
    """
    texts = pc.ascii_trim_whitespace(pc.fill_null(flat(texts).cast(pa.large_string()), ""))
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat_words = lists.flatten()
    blank = np.asarray(pc.equal(pc.binary_length(texts), 0), dtype=bool)
    if blank.any():
        flat_words = flat_words.filter(pa.array(~np.repeat(blank, counts)))
        counts = np.where(blank, 0, counts)
    codes = flat_words.dictionary_encode()
    names = codes.dictionary.to_numpy(zero_copy_only=False)
    if fold and len(names):
        lowered = (name.lower() for name in names)
        names = np.array([name if name.isalnum() else _MARKS.sub("", name) for name in lowered], object)
        used = (names != "")[np.asarray(codes.indices)]
        if not used.all():
            flat_words, codes = flat_words.filter(pa.array(used)), codes.filter(pa.array(used))
            counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[used], minlength=len(counts))
    known = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    return Words(flat_words, known[np.asarray(codes.indices)], counts)


class Runs:
    """Hashes of runs of consecutive words, by a running polynomial."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.full(n + 1, _INVERSE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes) * power[:n], out=self._sums[1:])
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        self._up = np.multiply.accumulate(power)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """The hash of the ``length`` words from each of ``starts``."""
        return mix((self._sums[starts + length] - self._sums[starts]) * self._up[starts])


def by_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    values = np.sort(hashes)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and the number of each of ``values`` among them."""
    codes = pa.array(values).dictionary_encode()
    names = codes.dictionary.to_numpy()
    order = np.argsort(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return names[order], rank[codes.indices.to_numpy()]


def release() -> None:
    """Gives free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def batches(stream: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that memory stays bounded.

    What a batch has left in the allocators goes back to the system: workers are kept for
    later stages, and an executor's memory is shared by all of them.
    """
    for batch in stream:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            release()


def chunked(docs: DataFrame, chunk_bytes: int = 4 << 20) -> tuple[DataFrame, int]:
    """(chunk, row) of every document, shuffled by chunk, and the bytes of all texts.

    Chunks are ranges of doc_id of about ``chunk_bytes`` of text, numbered in the order
    of doc_id (null first). At most 10,000 quantiles are taken; beyond that size a range
    between two of them is cut evenly. The shuffle is one exchange that later joins on
    ``chunk`` find again.
    """
    size, ids = docs.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    size = int(size or 0)
    wanted = max(1, -(-size // chunk_bytes))
    ranges = min(wanted, 10_000)
    inner = -(-wanted // ranges)
    cuts = np.zeros(0, np.int64)
    if ids and ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        quantiles = F.percentile_approx("doc_id", shares, max(10_000, 10 * ranges))
        cuts = np.unique(np.array(docs.agg(quantiles).first()[0], np.int64))

    @F.pandas_udf("long")
    def number(doc_id: pd.Series) -> pd.Series:
        ids = doc_id.fillna(-(2**63)).to_numpy(np.int64)
        at = np.searchsorted(cuts, ids, side="right")
        if inner == 1 or len(cuts) < 2:
            return pd.Series(at * inner)
        low = cuts[np.clip(at - 1, 0, len(cuts) - 1)]
        high = cuts[np.clip(at, 0, len(cuts) - 1)]
        part = (ids - low) * float(inner) / np.maximum(high - low, 1)
        inside = (at > 0) & (at < len(cuts))
        return pd.Series(at * inner + np.where(inside, np.clip(part, 0, inner - 1), 0).astype(np.int64))

    width = shuffle_width(docs.sparkSession, size)
    rows = docs.select(number(F.col("doc_id").cast("long")).alias("chunk"), F.struct("*").alias("row"))
    return rows.repartition(width, "chunk"), size


def ordered(table: pa.Table) -> pa.Table:
    """Rows of a chunk in the order of doc_id (null first), then text."""
    row = table.column("row")
    keys = pa.table({
        "doc_id": pc.struct_field(row, "doc_id"),
        "text": pc.struct_field(row, "text"),
        "rank": pa.array(np.arange(table.num_rows)),
    })
    by = [(name, "ascending") for name in keys.column_names]
    return table.take(pc.sort_indices(keys, sort_keys=by, null_placement="at_start"))
