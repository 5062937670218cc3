"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its runs of five words (a shorter text: of all its words),
words in lower case without punctuation. A shingle weighs (1 + ln tf) * (1 + IDF_SHARE * idf),
idf scaled to 0..1: it falls from 1, for a shingle in at most 1 / ``RARE`` of the documents,
to 0 for one in all. So what is a document's own counts more than a passage that many share,
but a few changed words do not part near copies that come in thousands. Document frequencies are exact over all
documents; those above the floor are at most ``RARE`` times the shingles of a mean document,
which bounds the table that is broadcast.

Each text gets BANDS * ROWS samples; two texts agree in one with a probability equal to
their weighted Jaccard similarity. Texts that agree in two bands share a bucket and are
candidates, unless their weights rule out the similarity. Candidates are verified by their
exact weighted Jaccard similarity, in rounds. First every text meets one lead, the best
known text of the largest class of its largest bucket; with the classes found it meets the
next, while a tenth of these pairs or more are similar. So a family comes together around
the text it was copied from, by a few pairs a member. Of the texts still apart the weight
counts that another of them has as well; what is a text's own can only lower a similarity.
That weight is summed up in ``PARTS`` parts by the hash of the shingle: two texts have in
common at most the lesser sum of each part, which rules most pairs out unread. Then, in every bucket with several classes, some members
lead, are compared with all its members of other classes that they can be similar to, and
leave it, four times as many each round, until no bucket has two classes. So every two
candidates were compared, ruled out by such bounds or are in one class. Copies are one
node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.llm.common import Runs, batches, by_hash, found, mix, read, split_words, stage

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 3
RARE = 250
LEADERS = 8
PARTS = 64
TILE = 1 << 17
IDF_SHARE = 0.25
_BLOCK = 1 << 15
_LOG = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
_LOW = np.uint64(0xFFFF)


def runs_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every shingle of every text, in no order."""
    words = split_words(texts, fold=True)
    runs = Runs(words.hashes)
    starts = np.flatnonzero(words.left >= WIDTH)
    hashes, owner = runs.at(starts, WIDTH), words.owner[starts]
    for length in range(1, WIDTH):
        short = np.flatnonzero(words.counts == length)
        hashes = np.append(hashes, runs.at(words.starts[short], length))
        owner = np.append(owner, short)
    return owner, hashes


def distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, times) of distinct pairs, owners rising."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if not len(hashes):
        return owner, hashes, np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[cuts], hashes[cuts], np.diff(np.append(cuts, len(hashes)))


def shingles(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, times) of the distinct shingles of every text, owners rising."""
    return distinct(*runs_of(texts))


def frequent_shingles(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document frequencies) of the shingles in more than rows / RARE documents.

    A shingle over the floor still has half of it when every batch of texts leaves out the
    first 1 / (2 RARE) of its own size; that sum, over all places of a shingle, picks the
    candidates, at most 2 RARE times the shingles of a mean document. A second pass counts
    the documents of the candidates exactly; only their places are sorted.
    """

    def surplus(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            values, n = by_hash(runs_of(batch.column("text"))[1])
            left_out = batch.num_rows / (2 * RARE)
            over = n > left_out
            yield pa.record_batch([pa.array(values[over].view(np.int64)), pa.array(n[over] - left_out)], ["shingle", "n"])

    texts = docs.select("text")
    picked = (
        texts.mapInArrow(surplus, "shingle long, n double")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= rows / (2 * RARE) - 1e-6)
        .select("shingle")
        .toArrow()
    )
    table = np.sort(picked.column("shingle").to_numpy().view(np.uint64))

    def exact(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            owner, hashes = runs_of(batch.column("text"))
            kept = found(hashes, table)
            values, n = by_hash(distinct(owner[kept], hashes[kept])[1])
            yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(n)], ["shingle", "n"])

    counted = (
        texts.mapInArrow(exact, "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > rows / RARE)
        .toArrow()
    )
    hashes = counted.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], counted.column("n").to_numpy()[order]


class Weights:
    """Shingle weights from the frequencies above the floor."""

    def __init__(self, rows: int, hashes: np.ndarray, counts: np.ndarray):
        self.hashes = hashes
        self.idf = np.clip(np.log(max(rows, 1) / np.maximum(counts, 1)) / np.log(RARE), 0, 1)

    def __call__(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        idf = np.ones(len(hashes))
        if len(self.hashes):
            hot = found(hashes, self.hashes)
            idf[hot] = self.idf[np.searchsorted(self.hashes, hashes[hot])]
        return (1 + np.log(times)) * (1 + IDF_SHARE * idf)


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Band keys, one row a text; texts without shingles get zeros."""
    out = np.zeros((n, BANDS), np.uint64)
    cuts = np.searchsorted(owner, np.arange(n + 1))
    log_weight = np.log(weights).astype(np.float32)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + _BLOCK, side="right")) - 1)
        part = slice(cuts[at], cuts[to])
        sizes = np.diff(cuts[at : to + 1])
        has = np.flatnonzero(sizes)
        if len(has):
            out[at + has] = _sample(hashes[part], log_weight[part], sizes[has])
        at = to
    return out


def _sample(h: np.ndarray, log_weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    keys = np.zeros((len(sizes), BANDS), np.uint64)
    h = mix(h)
    for band in range(BANDS):
        key = np.full(len(sizes), band + 1, np.uint64)
        for row in range(ROWS):
            seed = 2 * (band * ROWS + row) + 1
            z = h * np.uint64((0x9E3779B97F4A7C15 * seed) & (1 << 64) - 1)
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(32)
            shift = (((z * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.float32) + 0.5) / 65536
            rate = _LOG[z & _LOW] + _LOG[(z >> np.uint64(16)) & _LOW]
            scale = _LOG[(z >> np.uint64(32)) & _LOW] + _LOG[z >> np.uint64(48)]
            level = np.floor(log_weight / rate + shift)
            value = np.log(scale) - rate * (level - shift) - rate
            least = np.minimum.reduceat(value, starts)
            ties = np.flatnonzero(value == np.repeat(least, sizes))
            first = ties[np.searchsorted(ties, starts)]
            key = mix(key ^ mix(h[first] + (level[first].astype(np.int64).view(np.uint64) << np.uint64(1))))
        keys[:, band] = key
    return keys


def similarity(a, b, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of two columns of texts, row by row."""
    n = len(a)
    both = shingles(pa.concat_arrays([a, b]))
    side, owner = both[0] >= n, both[0] % n
    weight = weights(both[1], both[2])
    order = np.lexsort((side, both[1], owner))
    owner, hashes, weight = owner[order], both[1][order], weight[order]
    same = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    low = np.minimum(weight[1:], weight[:-1])[same]
    common = np.bincount(owner[1:][same], low, n)
    total = np.bincount(owner, weight, n) - common
    return np.divide(common, total, out=np.zeros(n), where=total > 0)


def components(links: DataFrame) -> DataFrame:
    """(node, class): the least node each node of ``links`` (a, b) is connected with."""
    both = stage(links.union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("class")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("class").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("class", "m").alias("class"), F.col("class").alias("old"))
        up = labels.select(F.col("node").alias("class"), F.col("class").alias("above"))
        after = stage(lower.join(up, "class", "left").select("node", F.least("class", F.coalesce("above", "class")).alias("class"), "old"), "labels")
        labels = after.select("node", "class")
        if after.filter(F.col("class") != F.col("old")).isEmpty():
            return labels


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, total, shared, fame, class): the pairs of bands a node shares with another.

    ``shared`` bounds the weight of what it can have in common with another text; ``fame`` is
    how many nodes have its bands, most for the text that a family was copied from.
    """
    bands = nodes.select("node", "total", F.posexplode("bands").alias("band", "key")).filter("key != 0")
    crowded = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    hits = F.array_sort(F.collect_list(F.struct("band", "key"))).alias("hits")
    shared = bands.join(crowded, "key").groupBy("node", "total").agg(hits, F.sum("n").alias("fame"))
    pairs = F.flatten(
        F.transform("hits", lambda x: F.transform(F.filter("hits", lambda y: y["band"] > x["band"]), lambda y: F.xxhash64(x["key"], y["key"])))
    )
    rows = shared.select("node", "total", "fame", F.explode(pairs).alias("key"))
    return rows.select("key", "node", "total", F.col("total").alias("shared"), "fame", F.col("node").alias("class"))


_MEMBER = ("key", "node", "total", "shared", "fame")
_HELD = ("bands", "parts")


def _carried(members: DataFrame) -> list[str]:
    """The columns that a member keeps from round to round."""
    return [*_MEMBER, *(name for name in _HELD if name in members.columns)]


def _with_bands(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``members`` with the ``bands`` of their nodes."""
    return members.join(nodes.select("node", "bands"), "node")


def _unsettled(members: DataFrame) -> DataFrame:
    """The members of the buckets with several classes, with the bucket's ``size``, its
    ``largest`` class and the node of most fame in it, ``lead``."""
    lead = F.max(F.struct("fame", "node", "total", "shared")).alias("lead")
    sizes = members.groupBy("key", "class").agg(F.count("*").alias("n"), lead)
    several = sizes.groupBy("key").agg(
        F.sum("n").alias("size"), F.max(F.struct("n", "lead", "class")).alias("top"), F.count("*").alias("classes")
    )
    open_ = several.filter("classes > 1").select("key", "size", F.col("top.class").alias("largest"), F.col("top.lead").alias("lead"))
    return members.hint("merge").join(open_, "key").select(*_carried(members), "class", "size", "largest", "lead")


def _reachable(total: Column, shared: Column, other_total: Column, other_shared: Column) -> Column:
    """Whether two texts can be similar: they have at most the lesser ``shared`` in common."""
    common = F.least(shared, other_shared)
    return common * (1 + 1e-9) >= SIMILARITY * (total + other_total - common)


def parts_of(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The weight of each text in PARTS parts by the hash of the shingle, never rounded down."""
    part = (mix(hashes) % np.uint64(PARTS)).astype(np.int64)
    sums = np.bincount(owner * PARTS + part, weights, n * PARTS)
    return np.where(sums > 0, np.nextafter(sums.astype(np.float32), np.float32(np.inf)), np.float32(0))


def _alike(total: Column, parts: Column, other_total: Column, other_parts: Column) -> Column:
    """Whether two texts can be similar: of each part they have at most the lesser weight in common."""
    least = F.zip_with(parts, other_parts, lambda x, y: F.least(x, y))
    common = F.aggregate(least, F.lit(0.0), lambda sum_, x: sum_ + x.cast("double"))
    return common * ((1 + SIMILARITY) * (1 + 1e-9)) >= SIMILARITY * (total + other_total)


def _pair(one: Column, other: Column) -> list[Column]:
    return [F.greatest(one, other).alias("a"), F.least(one, other).alias("b")]


def _nearest(members: DataFrame, compared: DataFrame | None) -> DataFrame:
    """(a, b), a > b: each node with the lead of the largest bucket that another class leads,
    of those it was not ``compared`` with.

    At most one pair a node, however large the buckets: enough to bring a family together.
    """
    near = _reachable(F.col("total"), F.col("shared"), F.col("lead.total"), F.col("lead.shared"))
    apart = members.filter((F.col("class") != F.col("largest")) & near)
    leads = apart.groupBy("node", F.col("lead.node").alias("other")).agg(F.max("size").alias("size"))
    leads = leads.select(*_pair(F.col("node"), F.col("other")), "node", "other", "size")
    if compared is not None:
        leads = leads.join(compared.select("a", "b"), ["a", "b"], "left_anti")
    chosen = leads.groupBy("node").agg(F.max(F.struct("size", "other")).alias("best"))
    return chosen.select(*_pair(F.col("node"), F.col("best.other"))).distinct()


def _marked(members: DataFrame, most: int) -> DataFrame:
    """``members`` with ``leads``: of every bucket up to ``most`` of them, one of each class
    first, none of its largest class, since the bucket is done when the members of all other
    classes have led."""
    inside = Window.partitionBy("key", "class").orderBy("node")
    across = Window.partitionBy("key").orderBy(F.desc("eligible"), "turn", "node")
    turns = members.withColumn("turn", F.row_number().over(inside))
    ranked = turns.withColumn("eligible", (F.col("class") != F.col("largest")) & (F.col("turn") <= most))
    leads = F.col("eligible") & (F.row_number().over(across) <= most)
    return ranked.withColumn("leads", leads).drop("turn", "eligible")


def _leaders(members: DataFrame, most: int) -> DataFrame:
    """The members that lead their buckets."""
    return _marked(members, most).filter("leads").select(*_carried(members), "class", "size")


def _first_shared(bands: Column, other: Column) -> Column:
    """The key of the bucket of the first two bands that two nodes share."""
    both = F.filter(F.zip_with(bands, other, lambda x, y: F.when((x == y) & (x != 0), x)), lambda x: x.isNotNull())
    return F.xxhash64(F.get(both, F.lit(0)), F.get(both, F.lit(1)))


def _pairs(members: DataFrame, leaders: DataFrame, most: int, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b), a > b: leaders with their bucket's members of other classes.

    A bucket is cut into tiles of its members, each of about TILE pairs; the leaders go to all.
    Two nodes that agree in m bands share m (m - 1) / 2 buckets. With their bands, carried by
    the members or looked up in ``nodes``, they only meet in the one of the first two, so the
    join makes a pair once, or twice where both lead. Until that bucket is done they stay
    apart in the others as well. With their ``parts`` only those meet that can be similar.
    """
    tiles = F.ceil(F.col("size") * F.lit(most) / F.lit(TILE))
    if nodes is not None:
        members, leaders = _with_bands(members, nodes), _with_bands(leaders, nodes)
    known = [name for name in _carried(members) if name in _HELD]
    left = members.select("key", F.pmod(F.xxhash64("node"), tiles).alias("tile"), "node", "total", "shared", "class", *known)
    right = leaders.select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"),
        F.col("node").alias("leader"), F.col("total").alias("other_total"), F.col("shared").alias("other_shared"), F.col("class").alias("other"),
        *(F.col(name).alias(f"other_{name}") for name in known),
    )
    near = _reachable(F.col("total"), F.col("shared"), F.col("other_total"), F.col("other_shared"))
    met = left.join(right, ["key", "tile"]).filter("class != other").filter(near)
    if "bands" in known:
        met = met.filter(F.col("key") == _first_shared(F.col("bands"), F.col("other_bands")))
    if "parts" in known:
        met = met.filter(_alike(F.col("total"), F.col("parts"), F.col("other_total"), F.col("other_parts")))
    return met.select(*_pair(F.col("node"), F.col("leader"))).distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest) of every row; (digest, id, node, class_id) of every text; links."""
    spark = docs.sparkSession
    rows = docs.count()
    weights = spark.sparkContext.broadcast(Weights(rows, *frequent_shingles(docs, rows)))

    def sign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            owner, hashes, times = shingles(batch.column("text"))
            weight = weights.value(hashes, times)
            keys = signatures(owner, hashes, weight, batch.num_rows)
            total = pa.array(np.bincount(owner, weight, batch.num_rows).astype(float))
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("digest"), bands, total], ["doc_id", "digest", "bands", "total"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    signed = stage(texts.withColumn("digest", digest).mapInArrow(sign, "doc_id long, digest string, bands array<long>, total double"), "signed")
    own = F.coalesce(F.min("doc_id"), -1 - F.abs(F.xxhash64("digest")))
    nodes = signed.groupBy("digest").agg(
        F.min("doc_id").alias("id"), own.alias("node"), F.first("bands").alias("bands"), F.first("total").alias("total")
    )
    nodes = stage(nodes, "nodes")
    members = stage(_unsettled(stage(_buckets(nodes), "buckets")), "members")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    held = texts.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    held = stage(held, "texts")

    def verify(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1000):
            near = similarity(batch.column("left"), batch.column("right"), weights.value)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(near)], ["a", "b", "similarity"])

    def spread(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            owner, hashes, times = shingles(batch.column("text"))
            node = batch.column("doc_id").take(pa.array(owner))
            yield pa.record_batch([node, pa.array(hashes.view(np.int64))], ["node", "shingle"])

    def parted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            owner, hashes, times = shingles(batch.column("text"))
            weight, n = weights.value(hashes, times), batch.num_rows
            single = batch.column("single")
            mine = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(single), 0).to_numpy())
            alone = pc.list_flatten(single).to_numpy().view(np.uint64)
            # Both name a shingle once: what comes twice is no other text's.
            met = distinct(np.append(owner, mine), np.append(hashes, alone))[2] == 1
            total = np.bincount(owner, weight, n).astype(float)
            owner, hashes, weight = owner[met], hashes[met], weight[met]
            shared = np.bincount(owner, weight, n).astype(float)
            sums = parts_of(owner, hashes, weight, n)
            offsets = pa.array(np.arange(0, sums.size + 1, PARTS, dtype=np.int32))
            parts = pa.ListArray.from_arrays(offsets, pa.array(sums))
            columns = [batch.column("doc_id"), pa.array(total), pa.array(shared), parts]
            yield pa.record_batch(columns, ["node", "total", "shared", "parts"])

    def narrowed(members: DataFrame) -> DataFrame:
        """``members`` with ``shared`` less the weight of the shingles that no other of them has,
        and the rest in ``parts``."""
        still = held.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
        each = still.mapInArrow(spread, "node long, shingle long")
        single = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("doc_id")).filter("n = 1")
        own = single.groupBy("doc_id").agg(F.collect_list("shingle").alias("single"))
        known = still.join(own, "doc_id", "left").mapInArrow(parted, "node long, total double, shared double, parts array<float>")
        known = known.filter(F.col("shared") * (1 + 1e-9) >= SIMILARITY * F.col("total"))
        return members.select("key", "node", "fame", "class").join(known, "node")

    # First every node meets one lead a round, while many of them turn out similar: families
    # come together by about one pair a member. What is left apart then meets bucket by bucket.
    compared, labels, most, gathering, gathered = None, None, LEADERS, True, False
    while not members.isEmpty():
        left = members.select(*_carried(members))
        if gathering:
            pairs = _nearest(members, compared)
        else:
            marked = stage(_marked(members, most), "marked")
            pairs = _pairs(marked, marked.filter("leads"), most).join(compared.select("a", "b"), ["a", "b"], "left_anti")
            left = marked.filter(~F.col("leads")).select(*_carried(members))
            most *= 4
        pairs = stage(pairs, "pairs")
        sides = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a").join(
            held.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b"
        )
        checked = stage(sides.mapInArrow(verify, "a long, b long, similarity double"), "checked")
        similar = F.col("similarity") >= SIMILARITY
        if gathering:
            n, alike = checked.agg(F.count("*"), F.count_if(similar)).first()
            gathering, gathered = alike * 10 > n, alike * 10 <= n
        compared = checked if compared is None else compared.unionByName(checked)
        links = compared.filter(similar).select("a", "b")
        labels = components(links)
        left = left.join(labels, "node", "left").select(*_carried(left), F.coalesce("class", "node").alias("class"))
        members = stage(_unsettled(left), "members")
        if gathered:
            # Few are left: they carry their bands and parts from here on.
            members, gathered = stage(_with_bands(_unsettled(narrowed(members)), nodes), "members"), False
    found_nodes = nodes.select("digest", "id", "node")
    if labels is None:
        links = spark.createDataFrame([], "a long, b long")
        found_nodes = found_nodes.withColumn("class_id", F.col("node"))
    else:
        found_nodes = found_nodes.join(labels, "node", "left").withColumn("class_id", F.coalesce("class", "node"))
    return signed.select("doc_id", "digest"), found_nodes, links


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of near duplicates, and verified links that hold them together.

    The first result has, for every row of ``docs``, (doc_id, digest of the text, class_id).
    The links (a, b) are pairs of similar texts, enough of them to connect every class; they
    are not all of its pairs, whose number grows with the square of a class. The class is the least doc_id of it. Texts without words are alike
    only as copies. A null doc_id never leads a class with other rows; where a text has no
    other, the class is a negative number drawn from the digest and only copies join it.
    """
    rows, texts, links = _grouped(docs)
    return rows.join(texts.select("digest", "class_id"), "digest"), links


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lead their class; of equal rows one."""
    _, texts, _ = _grouped(docs)
    leads = texts.filter("node = class_id").select(F.col("id").alias("lead"), F.col("digest").alias("lead_digest"))
    marked = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
    )
    same = (F.col("digest") == F.col("lead_digest")) & F.col("id").eqNullSafe(F.col("lead"))
    return marked.join(leads, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")


def op7_icws_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates, and whether it leads the class."""
    classes, _ = near_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


QUERIES = {"op7_icws_minhash": op7_icws_minhash}
ORACLES = {}
