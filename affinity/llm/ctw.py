"""Language-model scores by context-tree weighting over bytes.

A text is scored as its token sequence: lower-cased words, one space between, one end
byte. Each byte is eight binary decisions; each decision has a context tree over the last
``depth`` bytes. A node holds the counts of zeros and ones seen after its context in all
training texts and a Krichevsky-Trofimov estimate; a weighted node mixes its own estimate
with the product over its longer contexts, half and half, so every depth takes part in the
prediction. The weights are fixed after training; a context that was never seen takes the
estimate of the longest context that was.

Counts and weights cover every byte run of the training texts. The tree is kept in parts by
the last CUT bytes of a context: a part weighs its nodes bottom-up, the levels above CUT,
which the number of bytes bounds, are weighed on the driver, and a second pass over the parts
gives the probability of every distinct run of all texts. Chunks of documents ask for those
of their runs by hash group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.common import batches, chunked, mix, numbered, read, release, split_words, stage, typed

DEPTH = 5
CUT = 2
RUNS_PER_PART = 250_000
END = 0x0A
_END_TOKEN = np.uint64(0x0A0A0A0A0A0A0A0A)
_EIGHT = np.uint64(8)
_BLOCK = 1 << 19


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; one without id is not."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def encode(words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (``depth`` bytes before, byte) for every byte of some texts, and how many
    each text has. Before a text stand end bytes."""
    offsets = pa.array(words.starts.astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, words.text), pa.scalar(" ", pa.large_string()))
    edge, before = (pa.scalar(chr(END) * n, pa.large_string()) for n in (1, depth))
    padded = pc.binary_join_element_wise(before, joined, edge, pa.scalar("", pa.large_string()))
    sizes = np.asarray(pc.binary_length(padded)).astype(np.int64)
    data = np.frombuffer(padded.buffers()[2] or b"", np.uint8)[: sizes.sum()]
    codes = np.zeros(max(0, len(data) - depth), np.uint64)
    for i in range(depth + 1):
        codes = (codes << _EIGHT) | data[i : len(data) - depth + i]
    ends = np.cumsum(sizes)
    use = np.ones(len(data), bool)
    for i in range(depth):
        use[ends - sizes + i] = False
    return codes[use[depth:]], sizes - depth


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability the estimator gives a sequence with these counts."""
    zeros, ones = zeros.astype(float), ones.astype(float)
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


class Tree:
    """Predictions of the weighted tree, from counts of byte runs by depth."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.depth = len(counts) - 1
        self.nodes = [[None] * 8 for _ in counts]
        for bit in range(8):
            levels = [self._level(*counts[d], bit) for d in range(self.depth + 1)]
            self._weigh(levels, bit)

    @staticmethod
    def _level(codes: np.ndarray, n: np.ndarray, bit: int):
        byte = codes & np.uint64(255)
        prefix = (byte >> np.uint64(8 - bit)) | np.uint64(1 << bit)
        keys = ((codes >> _EIGHT) << _EIGHT) | prefix
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        if not len(keys):
            return keys, n, n
        return keys[cuts], np.add.reduceat(n * (1 - one), cuts), np.add.reduceat(n * one, cuts)

    def _weigh(self, levels, bit: int) -> None:
        parents = [None]
        for d in range(1, len(levels)):
            keys = levels[d][0]
            up = ((keys >> _EIGHT) & np.uint64((1 << (8 * (d - 1))) - 1)) << _EIGHT | (keys & np.uint64(255))
            parents.append(np.searchsorted(levels[d - 1][0], up))
        weight, below = [None] * len(levels), None
        for d in reversed(range(len(levels))):
            keys, zeros, ones = levels[d]
            own = log_block(zeros, ones)
            if d == self.depth:
                weight[d], below = np.ones(len(keys)), own
                continue
            at, (_, z, o) = parents[d + 1], levels[d + 1]
            split = np.bincount(at, below, len(keys)).astype(float)
            rest = [x - np.bincount(at, y, len(keys)) for x, y in ((zeros, z), (ones, o))]
            split += log_block(*rest)
            mixed = np.logaddexp(own, split) - np.log(2)
            weight[d], below = np.exp(own - np.log(2) - mixed), mixed
        above, left = np.zeros(len(levels[0][0])), np.ones(len(levels[0][0]))
        for d, (keys, zeros, ones) in enumerate(levels):
            estimate = (ones + 0.5) / (zeros + ones + 1)
            self.nodes[d][bit] = (keys, (above + left * estimate).astype(np.float32))
            if d < self.depth:
                at = parents[d + 1]
                above, left = (above + left * weight[d] * estimate)[at], (left * (1 - weight[d]))[at]

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's byte after its context."""
        total = np.zeros(len(codes))
        byte = codes & np.uint64(255)
        for bit in range(8):
            prefix = (byte >> np.uint64(8 - bit)) | np.uint64(1 << bit)
            one = np.full(len(codes), 0.5)
            open_ = np.arange(len(codes))
            for d in reversed(range(self.depth + 1)):
                keys, share = self.nodes[d][bit]
                if not len(keys) or not len(open_):
                    continue
                context = (codes[open_] >> _EIGHT) & np.uint64((1 << (8 * d)) - 1)
                wanted = context << _EIGHT | prefix[open_]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                one[open_[hit]] = share[at[hit]]
                open_ = open_[~hit]
            total += np.log10(np.where((byte >> np.uint64(7 - bit)) & np.uint64(1) == 1, one, 1 - one))
        return total


def _up(keys: np.ndarray, d: int) -> np.ndarray:
    """The node one byte shorter of every node of level ``d``."""
    return ((keys >> _EIGHT) & np.uint64((1 << (8 * (d - 1))) - 1)) << _EIGHT | (keys & np.uint64(255))


def _climb(levels, below: np.ndarray):
    """Places of the parents, weights of all levels but the last, and the log probabilities
    of the first, from those ``below`` of the last. ``levels`` has (d, keys, zeros, ones)."""
    parents, weights = [], []
    for (_, shorter, zeros, ones), (d, keys, _, _) in reversed(list(zip(levels, levels[1:]))):
        at = np.searchsorted(shorter, _up(keys, d))
        own = log_block(zeros, ones)
        mixed = np.logaddexp(own, np.bincount(at, below, len(shorter))) - np.log(2)
        parents.insert(0, at)
        weights.insert(0, np.exp(own - np.log(2) - mixed))
        below = mixed
    return parents, weights, below


def _descend(levels, parents, weights, above, left):
    """(keys, share) of every level, and what reaches the last one."""
    nodes = []
    for i, (_, keys, zeros, ones) in enumerate(levels):
        estimate = (ones + 0.5) / (zeros + ones + 1)
        nodes.append((keys, (above + left * estimate).astype(np.float32)))
        if i < len(parents):
            at, weight = parents[i], weights[i]
            above, left = (above + left * weight * estimate)[at], (left * (1 - weight))[at]
    return nodes, above, left


def _counts(codes: np.ndarray, n: np.ndarray, first: int, depth: int):
    """(d, runs, n) of the levels from ``first`` to ``depth``, from the distinct runs of the last."""
    out = []
    for d in range(first, depth + 1):
        short, at = numbered(codes & np.uint64((1 << (8 * (d + 1))) - 1))
        out.append((d, short, np.bincount(at, n, len(short)).astype(np.int64)))
    return out


def _levels(counts, bit: int):
    """(d, keys, zeros, ones) of the same levels."""
    return [(d, *Tree._level(short, n, bit)) for d, short, n in counts]


def _top(table: pa.Table, cut: int):
    """Nodes of the levels above ``cut`` by bit, and (keys, above, left) of that of ``cut``."""
    nodes, reach = [[None] * 8 for _ in range(cut)], []
    bits = table.column("bit").to_numpy()
    columns = [table.column(c).to_numpy() for c in ("key", "zeros", "ones", "below")]
    for bit in range(8):
        keys, zeros, ones, below = (x[bits == bit] for x in columns)
        order = np.argsort(keys)
        levels, below = [(cut, keys[order].astype(np.uint64), zeros[order], ones[order])], below[order]
        for d in range(cut, 0, -1):
            _, longer, z, o = levels[0]
            short, at = np.unique(_up(longer, d), return_inverse=True)
            levels.insert(0, (d - 1, short, *(np.bincount(at, x, len(short)) for x in (z, o))))
        parents, weights, _ = _climb(levels, below)
        shares, above, left = _descend(levels, parents, weights, np.zeros(len(levels[0][1])), np.ones(len(levels[0][1])))
        for d in range(cut):
            nodes[d][bit] = shares[d]
        reach.append((levels[-1][1], above, left))
    return nodes, reach


def run_logs(docs: DataFrame, depth: int, groups: int) -> DataFrame:
    """(part, codes, logs): log10 probabilities of all distinct byte runs of ``docs``, packed
    by hash group; learned from the rows that are not ``out``."""
    cut = min(CUT, depth)

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1500):
            codes, sizes = encode(split_words(batch.column("text"), lower=True), depth)
            learn = np.repeat(~np.asarray(batch.column("out").to_numpy(zero_copy_only=False), bool), sizes)
            names, at = numbered(codes)
            n = np.bincount(at[learn], minlength=len(names))
            yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(n)], ["code", "n"])

    runs = docs.select("text", "out").mapInArrow(count, "code long, n long")
    runs = stage(runs.groupBy("code").agg(F.sum("n").alias("n")), "byte_runs")
    parts = max(1, -(-runs.count() // RUNS_PER_PART))
    near = F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * cut)) - 1))
    runs = runs.select(F.pmod(F.xxhash64(near), F.lit(parts)).alias("tree"), "code", "n")

    def sorted_runs(table):
        table = table.sort_by("code")
        return table.column("code").to_numpy().astype(np.uint64), table.column("n").to_numpy()

    def bottom(table):
        release()
        codes, n = sorted_runs(table)
        counts = _counts(codes[n > 0], n[n > 0], cut, depth)
        out = []
        for bit in range(8):
            levels = _levels(counts, bit)
            below = _climb(levels, log_block(*levels[-1][2:]))[2]
            _, keys, zeros, ones = levels[0]
            out.append(pa.table({
                "bit": pa.array(np.full(len(keys), bit, np.int64)),
                "key": pa.array(keys.astype(np.int64)),
                "zeros": pa.array(zeros.astype(np.int64)),
                "ones": pa.array(ones.astype(np.int64)),
                "below": pa.array(below.astype(float)),
            }))
        return pa.concat_tables(out)

    tops = runs.groupBy("tree").applyInArrow(bottom, "bit long, key long, zeros long, ones long, below double")
    shared = docs.sparkSession.sparkContext.broadcast(_top(tops.toArrow(), cut))

    def predict(table):
        release()
        codes, n = sorted_runs(table)
        upper, reach = shared.value
        tree = Tree.__new__(Tree)
        tree.depth, tree.nodes = depth, [*upper, *([None] * 8 for _ in range(cut, depth + 1))]
        counts = _counts(codes[n > 0], n[n > 0], cut, depth)
        for bit in range(8):
            levels = _levels(counts, bit)
            parents, weights, _ = _climb(levels, log_block(*levels[-1][2:]))
            keys, above, left = reach[bit]
            at = np.searchsorted(keys, levels[0][1])
            for d, node in enumerate(_descend(levels, parents, weights, above[at], left[at])[0], cut):
                tree.nodes[d][bit] = node
        logs = np.concatenate([tree._bits(codes[at : at + _BLOCK]) for at in range(0, len(codes), _BLOCK)])
        order, names, starts = _dealt(codes, groups)
        return pa.table({
            "part": pa.array(names),
            "codes": pa.array([x.tobytes() for x in np.split(codes[order], starts[1:])], pa.binary()),
            "logs": pa.array([x.tobytes() for x in np.split(logs[order].astype(np.float32), starts[1:])], pa.binary()),
        })

    return runs.groupBy("tree").applyInArrow(predict, "part long, codes binary, logs binary")


def _dealt(codes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of ``codes`` by hash group, the groups that occur and where each starts."""
    group = (mix(codes) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    return order, group[order][starts], starts


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(row, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``;
    ``row`` has all its columns but the text.

    Learns from the rows that are not :func:`held_out`. Null and blank texts have the end
    token only. Word counts and probabilities of byte runs are exact: every chunk of documents
    sends its distinct words and runs to groups by hash and gets its answers back.
    """
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("all")
    marked = docs.select("text", "doc_id", held_out(F.col("doc_id")).alias("out"), rest)
    rows, size = chunked(marked)
    groups = max(1, -(-size // (16 << 20)))
    logs = run_logs(marked, depth, groups)

    def wanted(table):
        """(runs, run number of every byte, how many each text has), and (words, distinct
        tokens, token number of every word, training counts) of a chunk."""
        row = pc.struct_field(table.column("row"), "text")
        learn = ~np.asarray(pc.struct_field(table.column("row"), "out").combine_chunks().to_numpy(zero_copy_only=False), bool)
        words = split_words(row, lower=True)
        names, at = numbered(np.append(words.hashes, _END_TOKEN))
        seen = np.append(np.repeat(learn, words.counts), False)
        counts = np.bincount(at[seen], minlength=len(names))
        counts[at[-1]] += learn.sum()
        codes, sizes = encode(words, depth)
        return (*numbered(codes), sizes), (words, names, at, counts)

    # A chunk's tokens go to parts below ``groups``, its byte runs to those from there on.
    def ask(key, table):
        release()
        (runs, _, _), (_, names, _, counts) = wanted(table)
        order, parts, starts = _dealt(names, groups)
        packed = np.split(counts[order].astype(np.int32), starts[1:])
        also, more, cuts = _dealt(runs, groups)
        asked = [*np.split(names[order], starts[1:]), *(np.split(runs[also], cuts[1:]) if len(runs) else [])]
        return pa.table({
            "part": pa.array(np.append(parts, more + groups)),
            "chunk": pa.array(np.full(len(asked), key[0].as_py(), np.int64)),
            "names": pa.array([x.tobytes() for x in asked], pa.binary()),
            "counts": pa.array([x.tobytes() for x in packed] + [None] * (len(asked) - len(packed)), pa.binary()),
        })

    def answer(key, left, right):
        release()
        left = left.sort_by("chunk")
        packed = [np.frombuffer(x, np.uint64) for x in left.column("names").to_pylist()]
        types = np.zeros(len(packed), np.int64)
        if key[0].as_py() < groups:
            counts = np.concatenate([np.frombuffer(x, np.int32) for x in left.column("counts").to_pylist()])
            names, at = numbered(np.concatenate(packed))
            totals = np.bincount(at, counts, len(names)).astype(np.int64)
            types[0] = (totals > 0).sum()
            replies = np.split(totals[at], np.cumsum([len(x) for x in packed])[:-1])
        else:
            known = np.concatenate([np.frombuffer(x, np.uint64) for x in right.column("codes").to_pylist()])
            value = np.concatenate([np.frombuffer(x, np.float32) for x in right.column("logs").to_pylist()])
            order = np.argsort(known)
            known, value = known[order], value[order]
            replies = [value[np.searchsorted(known, x)] for x in packed]
        return left.select(["part", "chunk"]).append_column(
            "totals", pa.array([x.tobytes() for x in replies], pa.binary())
        ).append_column("types", pa.array(types))

    def finish(key, left, right):
        release()
        (runs, place, sizes), (words, names, at, counts) = wanted(left)
        right = right.sort_by("part")
        totals = np.empty(len(names), np.int64)
        packed = list(zip(right.column("part").to_pylist(), right.column("totals").to_pylist()))
        replies = [np.frombuffer(x, np.int64) for part, x in packed if part < groups]
        totals[_dealt(names, groups)[0]] = np.concatenate(replies)
        each, end = totals[at[:-1]], totals[at[-1]]
        n = len(words.counts)
        base = np.bincount(words.owner, np.log10(each + 0.5), n) + np.log10(end + 0.5)
        known = np.bincount(words.owner, each > 0, n).astype(np.int64) + int(end > 0)
        value = np.empty(len(runs), np.float32)
        value[_dealt(runs, groups)[0]] = np.concatenate([np.frombuffer(x, np.float32) for part, x in packed if part >= groups])
        logs = np.bincount(np.repeat(np.arange(n), sizes), value[place], n)
        extra = {"n_tokens": words.counts + 1, "n_known": known, "base": base, "score": logs}
        table = pa.table({"row": pc.struct_field(left.column("row"), "all")} | {k: pa.array(v) for k, v in extra.items()})
        facts = pa.table({
            "types": pa.array([right.column("types").to_numpy().sum()]),
            "learned": pa.array([int(counts.sum())]),
        })
        return pa.concat_tables([table, facts], promote_options="default").select(
            ["row", "n_tokens", "n_known", "base", "score", "types", "learned"]
        )

    asked = rows.groupBy("chunk").applyInArrow(ask, "part long, chunk long, names binary, counts binary")
    logs = logs.select((F.col("part") + groups).alias("part"), "codes", "logs")
    replies = (
        asked.groupBy("part")
        .cogroup(logs.groupBy("part"))
        .applyInArrow(answer, "part long, chunk long, totals binary, types long")
    )
    kind = docs.select(rest).schema["all"].dataType
    counts = "n_tokens long, n_known long, base double, score double, types long, learned long"
    schema = typed(row=kind, after=counts)
    scored = stage(rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema), "scored")
    types, learned = scored.agg(F.sum("types"), F.sum("learned")).first()
    types, learned = types or 0, learned or 0
    unit = float(np.log10(learned + 0.5 * (types + 1)))
    return scored.filter(F.col("n_tokens").isNotNull()).select(
        "row",
        "n_tokens",
        "n_known",
        F.lit(learned).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        "score",
    )


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the context tree, and the base score."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


QUERIES = {"op5_ctw": op5_ctw}
ORACLES = {}
