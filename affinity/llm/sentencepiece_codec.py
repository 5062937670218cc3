"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct chunks of text (a run of word marks and what follows) stand one after
another in one character array. Its suffixes are sorted as deep as the longest piece, by
doubling ranks; every piece of the vocabulary is found by binary search as a range of that
order. The ranges give edges (end, piece); sorted by position they are relaxed from left to
right, all chunks side by side: an edge holds if its piece may follow the piece that the
text before it ends with, and exactly one edge to each position does. Two pieces may follow
each other if byte-pair merging their joint text would give just these two.

The vocabulary is read on the driver from a model file (a parameter) and is as large as the
model, whatever the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.common import batches, flat, read, typed

MARK = "▁"
# Distinct chunks whose ids a task keeps for later batches; only speed depends on it.
REMEMBERED = 150_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Vocabulary:
    """Pieces in merge order: single characters, then longer ones by falling score.

    ``left`` and ``right`` are the two pieces each was last merged from (a character: itself).
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        names = [model.id_to_piece(i) for i in ids]
        self.bytes = np.zeros(256, np.int32)
        for i in ids:
            if model.is_byte(i):
                self.bytes[int(names[i][3:5], 16)] = i
        self.has_bytes = any(model.is_byte(i) for i in ids)
        self.unknown = model.unk_id()
        usable = [i for i in ids if not special[i]]
        chars = [i for i in usable if len(names[i]) == 1]
        longer = sorted((i for i in usable if len(names[i]) > 1), key=lambda i: (-model.get_score(i), i))
        order, rank = chars + longer, {}
        for n, i in enumerate(order):
            rank[names[i]] = n
        self.left, self.right, pieces, keep = [], [], [], []
        for n, i in enumerate(order):
            split = (n, n) if len(names[i]) == 1 else self._last_merge(names[i], rank)
            self.left.append(split[0] if split else n)
            self.right.append(split[1] if split else n)
            pieces.append(names[i])
            keep.append(split is not None)
        self.pieces, self.ids = pieces, np.array(order, np.int32)
        self.left, self.right = np.array(self.left, np.int64), np.array(self.right, np.int64)
        self.usable = np.array(keep)
        merged = np.flatnonzero(self.usable & (self.left != np.arange(len(order))))
        keys = self.left[merged] << 32 | self.right[merged]
        self.pair_keys, self.pair_of = np.sort(keys), merged[np.argsort(keys)]
        text = {n for n in names if len(n) > 1}
        inner = any(MARK in n.lstrip(MARK) for n in pieces)
        line = any("\n" in n for n in text)
        # Chunks end where no piece can reach across.
        self.chunk = None if inner else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if line else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        decoded = [b""] * len(names)
        for i in ids:
            if model.is_byte(i):
                decoded[i] = bytes([int(names[i][3:5], 16)])
            elif not special[i]:
                decoded[i] = names[i].replace(MARK, " ").encode()
        self.decoded = decoded

    @staticmethod
    def _last_merge(piece: str, rank: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece``; None if merging never makes it."""
        parts = list(piece)
        if any(c not in rank for c in parts):
            return None
        while len(parts) > 2:
            found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if rank.get(a + b, 1 << 30) < rank[piece]]
            if not found:
                return None
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return rank[parts[0]], rank[parts[1]]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of pieces ``a`` and ``b`` leaves just the two.

        Walks back the merges on both sides of the seam, latest first: at each step the
        seam's two neighbours must not have had a merge earlier than the one undone.
        """
        ok = np.ones(len(a), bool)
        open_ = np.flatnonzero((a < len(self.ids)) & (b < len(self.ids)))
        x, y = a[open_], b[open_]
        limit = np.full(len(open_), 1 << 40, np.int64)
        while len(open_):
            keys = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == keys) & (self.pair_of[at] < limit)
            ok[open_[bad]] = False
            undo_x = x > y
            new_limit = np.where(undo_x, x, y + 1)
            next_x = np.where(undo_x, self.right[x], x)
            next_y = np.where(undo_x, y, self.left[y])
            # A character cannot be undone: then the other side is, if it still can.
            stuck = np.where(undo_x, next_x == x, next_y == y)
            other_x = np.where(undo_x, x, self.right[x])
            other_y = np.where(undo_x, self.left[y], y)
            other_limit = np.where(undo_x, y + 1, x)
            other_stuck = np.where(undo_x, other_y == y, other_x == x)
            new_limit = np.where(stuck, other_limit, new_limit)
            next_x, next_y = np.where(stuck, other_x, next_x), np.where(stuck, other_y, next_y)
            go = ~bad & ~(stuck & other_stuck)
            open_, x, y, limit = open_[go], next_x[go], next_y[go], new_limit[go]
        return ok


class Matcher:
    """Piece occurrences in a batch of chunks by suffix array and binary search."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.lengths = np.array([len(p) for p in vocabulary.pieces])
        self.longest = int(self.lengths.max())
        self.chars = np.array([ord(p) for p in vocabulary.pieces if len(p) == 1])
        self.alphabet = np.unique(self.chars)
        codes = np.zeros((len(vocabulary.pieces), self.longest), np.int64)
        for n, p in enumerate(vocabulary.pieces):
            codes[n, : len(p)] = np.searchsorted(self.alphabet, [ord(c) for c in p]) + 1
        self.codes = codes
        self.char_of = np.full(len(self.alphabet) + 2, -1, np.int64)
        for n, p in enumerate(vocabulary.pieces):
            if len(p) == 1:
                self.char_of[codes[n, 0]] = n

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece in ``text``, which holds
        alphabet numbers, 0 between chunks and the highest for other characters."""
        used = np.unique(text)
        small = np.searchsorted(used, text).astype(np.uint64)
        bits = max(2, int(len(used)).bit_length())
        block = 64 // bits
        # Pieces with a character that the text lacks do not occur.
        ends = np.arange(self.longest) >= self.lengths[:, None]
        at = np.minimum(np.searchsorted(used, self.codes), len(used) - 1)
        here = np.flatnonzero(((used[at] == self.codes) | ends).all(axis=1) & self.v.usable & (self.lengths > 1))
        at, ends = at[here].astype(np.uint64), ends[here]
        n = len(text)
        keys = np.zeros(n, np.uint64)
        for i in range(block):
            keys <<= np.uint64(bits)
            keys[: n - i] |= small[i:]
        sorted_keys, rank = np.unique(keys, return_inverse=True)
        blocks = -(-self.longest // block)
        blocks = 1 << (blocks - 1).bit_length()
        low = np.zeros((len(here), blocks), np.int64)
        high = np.full((len(here), blocks), len(sorted_keys), np.int64)
        whole = np.zeros((len(here), blocks), bool)
        size = self.lengths[here]
        for b in range(blocks):
            first = np.zeros(len(here), np.uint64)
            last = np.zeros(len(here), np.uint64)
            for i in range(b * block, (b + 1) * block):
                past = ends[:, i] if i < self.longest else np.ones(len(here), bool)
                char = at[:, i] if i < self.longest else np.zeros(len(here), np.uint64)
                first = first << np.uint64(bits) | np.where(past, np.uint64(0), char)
                last = last << np.uint64(bits) | np.where(past, np.uint64((1 << bits) - 1), char)
            in_it = size > b * block
            low[in_it, b] = np.searchsorted(sorted_keys, first[in_it], side="left")
            high[in_it, b] = np.searchsorted(sorted_keys, last[in_it], side="right")
            whole[:, b] = size >= (b + 1) * block
        step = block
        while low.shape[1] > 1:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - step)] = rank[step:]
            sorted_pairs, rank = np.unique(rank.astype(np.int64) << 32 | ahead, return_inverse=True)
            a, b, c, d = low[:, ::2], high[:, ::2], low[:, 1::2], high[:, 1::2]
            full = whole[:, ::2]
            lower = np.where(full, a << 32 | c, a << 32)
            upper = np.where(full, a << 32 | d, b << 32)
            none = (a >= b) | full & (c >= d)
            low, high = np.searchsorted(sorted_pairs, lower), np.searchsorted(sorted_pairs, upper)
            high = np.where(none, low, high)
            whole = full & whole[:, 1::2]
            step *= 2
        suffixes = np.argsort(rank)
        starts = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=int(rank.max()) + 1 if n else 0))])
        low, high = starts[low[:, 0]], starts[np.maximum(high[:, 0], low[:, 0])]
        counts = high - low
        piece = np.repeat(here, counts)
        first = np.cumsum(counts) - counts
        position = suffixes[np.arange(counts.sum()) - np.repeat(first - low, counts)]
        return position, piece

    def segment(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of every chunk: all pieces in order, their characters, and how many each
        chunk has. Characters outside the vocabulary are given as piece ``len(ids)``."""
        lengths = np.asarray(pc.utf8_length(chunks)).astype(np.int64)
        text = np.frombuffer("\0".join(chunks.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(text)
        starts = np.cumsum(lengths + 1) - lengths - 1
        at = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        other = len(self.alphabet) + 1
        code = np.where(self.alphabet[at] == text, at + 1, other)
        inside = np.ones(n, bool)
        inside[starts[1:] - 1] = False
        code[~inside] = 0
        position, piece = self.edges(code)
        unknown = len(self.v.ids)
        single = np.where(code == other, unknown, self.char_of[np.minimum(code, len(self.alphabet))])
        where = np.flatnonzero(inside)
        ends = np.concatenate([position + self.lengths[piece], where + 1])
        piece = np.concatenate([piece, single[where]])
        size = np.append(self.lengths, 1)
        order = np.argsort((ends << 6) - np.minimum(size[piece], 63))
        ends, piece = ends[order], piece[order]
        edge_at = np.searchsorted(ends, np.arange(n + 2))
        last = np.full(n + 2, -1, np.int64)
        chunk_at = np.argsort(lengths, kind="stable")
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = chunk_at[np.searchsorted(lengths[chunk_at], step) :]
            here = starts[live] + step
            edge = edge_at[here]
            while len(here):
                candidate = piece[edge]
                source = here - size[candidate]
                begin = starts[live] == source
                before = np.where(begin, unknown, last[source])
                good = (before >= 0) & self.v.may_follow(before, candidate)
                last[here[good]] = candidate[good]
                more = ~good & (edge + 1 < edge_at[here + 1])
                live, here, edge = live[more], here[more], edge[more] + 1
        taken, owner, back = [], [], starts + lengths
        live = np.flatnonzero(lengths > 0)
        while len(live):
            got = last[back[live]]
            taken.append((back[live], got))
            owner.append(live)
            back[live] -= size[got]
            live = live[back[live] > starts[live]]
        if not taken:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(chunks), np.int64)
        ends = np.concatenate([t[0] for t in taken])
        got = np.concatenate([t[1] for t in taken])
        order = np.argsort(ends)
        counts = np.bincount(np.concatenate(owner), minlength=len(chunks))
        return got[order], text[ends[order] - 1], counts


class Codec:
    """Encodes and decodes Arrow columns of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.matcher = Matcher(vocabulary)
        self.decoded = pa.array(vocabulary.decoded, pa.large_binary())
        self.known: dict[str, int] = {}
        self.lists = pa.array([], pa.large_list(pa.int32()))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        parts, counts = [], []
        for text in pc.fill_null(flat(texts), "").to_pylist():
            marked = MARK + text.replace(" ", MARK) if text else ""
            chunks = self.v.chunk.findall(marked) if self.v.chunk else [marked] if marked else []
            parts.extend(chunks)
            counts.append(len(chunks))
        names = pa.array(parts, pa.large_string()).dictionary_encode()
        used = self._ids_of(names.dictionary).take(names.indices)
        per_chunk = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(used)).astype(np.int64))])
        text_ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return used.flatten().to_numpy(), np.diff(per_chunk[text_ends])

    def _ids_of(self, chunks: pa.Array) -> pa.Array:
        """The ids of each of some distinct chunks; those met lately are looked up."""
        if len(self.known) > REMEMBERED:
            self.known, self.lists = {}, self.lists[:0]
        names = chunks.to_pylist()
        fresh = [name for name in names if name not in self.known]
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        if fresh:
            self.lists = pa.concat_arrays([self.lists, self._match(pa.array(fresh, pa.large_string()))])
        return self.lists.take(pa.array([self.known[name] for name in names], pa.int64()))

    def _match(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk."""
        pieces, chars, sizes = self.matcher.segment(chunks)
        ids = np.append(self.v.ids, self.v.unknown)[pieces]
        lost = np.flatnonzero(pieces == len(self.v.ids))
        if len(lost) and self.v.has_bytes:
            raw = [chr(c).encode() for c in chars[lost]]
            width = np.ones(len(pieces), np.int64)
            width[lost] = [len(x) for x in raw]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ids = np.repeat(ids, width)
            is_lost = np.repeat(pieces == len(self.v.ids), width)
            ids[is_lost] = self.v.bytes[np.frombuffer(b"".join(raw), np.uint8)]
            sizes = np.bincount(owner, width, len(sizes)).astype(np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]))
        return pa.LargeListArray.from_arrays(offsets, pa.array(ids, pa.int32()))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of every run of ids; bytes that are no UTF-8 become U+FFFD."""
        pieces = self.decoded.take(pa.array(ids))
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(pieces)).astype(np.int64))])
        data = bytes(pieces.buffers()[2] or b"")
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [text.removeprefix(" ") for text in texts]


def encode(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``ids`` (array of int) and ``round_trip``, whether
    decoding the ids gives the text again.

    Null and empty texts have no ids. A text that itself holds the word mark U+2581 decodes
    to a space in its place. Texts are taken whole, whatever their length; repeated rows and
    further columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))
    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches(stream, 400):
            texts = pc.fill_null(pc.struct_field(batch.column("row"), "text"), "")
            ids, counts = codec.encode(texts)
            same = [a == b for a, b in zip(codec.decode(ids, counts), texts.to_pylist())]
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column("row"), lists, pa.array(same, pa.bool_())], ["row", "ids", "round_trip"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, typed(row=kind, after="ids array<int>, round_trip boolean"))


def decode(tokens: DataFrame, model_file: str = MODEL) -> DataFrame:
    """Each row of ``tokens`` as ``row``, with ``text``, decoded from its column ``ids``."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(model_file))
    kind = tokens.select(F.struct("*").alias("row")).schema["row"].dataType

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches(stream, 400):
            lists = pc.struct_field(batch.column("row"), "ids")
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            texts = codec.decode(flat(lists).flatten().to_numpy(), counts)
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return tokens.select(F.struct("*").alias("row")).mapInArrow(run, typed(row=kind, after="text string"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, and whether they decode to its text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select("row.doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip")


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES = {}
