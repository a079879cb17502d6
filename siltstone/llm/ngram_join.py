"""Exact Jaccard self-join of documents on word shingles, with its components and link counts.

Shingles are hashed into ``GROUPS`` groups. The counts of a document's shingles
by group are a point; two documents share at most the sum of the coordinates'
minima, so an R-tree over the points, whose nodes hold the largest coordinates
below them, finds who can be similar; counts in more groups, as many as suit
the sets' sizes, bound what is left once more, and the sets themselves decide.

One tree over all documents would have to be searched everywhere, as most
points lie close together. So points are first dealt to blocks in which similar
documents must meet: of two sets with a Jaccard similarity of 0.8 each shares a
shingle among its first fifth (and one more) in any fixed order. The order puts
frequent shingles last, so that common passages gather few documents.

Copies are one class from the start. The bounds make clusters: who may be
similar to whom, directly or through others. Of the pairs in a block that the
bounds allow only a spanning tree leaves the task, so a cluster of thousands
costs a row a member and not one a pair. Then each cluster's sets come together
once, tile by tile where there are many, and an index of their shingles gives
the exact similarities: the clusters' true components and each set's number of
links. Sets of sizes too far apart to be similar never share a tile.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read_table, row_key, slices, splitmix, text_bytes, written
from .graph import components
from .substring_dedup import _power

WORDS = 5
GROUPS = 32
FAN = 16  # children of a tree's node
NODE = 8  # members of a block that needs no tree
SLICE = 1 << 19  # bytes of text hashed at once
FREQUENT = 8  # shingles in more documents than this come last in the order
LIST = 1_000_000  # frequent shingles that are sent to the tasks, at most; all others only come earlier in the order
BUCKET = 1_500_000  # block entries that a task sorts
TILE = 5_000  # members of a block, or of each side of a pair of tiles, compared in one task
TILE_SHINGLES = 2_000_000  # of the members of a cluster compared in one task, about
#: Sizes of similar sets differ by a factor of 1.25 at most, so by one step of this factor.
STEP = 1.26

_odd = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, bounds: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts ``data[bounds[i]:bounds[i + 1]]``, A-Z lower-cased, and each text's first word.

    Words are the longest stretches of bytes that ``solid`` (256 flags) allows.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    up, down, values = _power(n)
    low = _lower[data]
    solid = solid[low]
    inside = bounds[(bounds > 0) & (bounds < n)]
    before = np.concatenate([[False], solid[:-1]])
    before[inside] = False
    start = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]])
    after[inside - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(values[low] * up[:n], dtype=np.uint64)])
    word = splitmix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return word, np.searchsorted(start, bounds)


def shingles(data: np.ndarray, bounds: np.ndarray, words: int = WORDS):
    """Of each text ``data[bounds[i]:bounds[i + 1]]`` the sorted distinct hashes of its shingles.

    Words are what lies between ASCII white space, A-Z lower-cased. A text with
    fewer words has all of them as one shingle, one without words none.
    """
    none = np.zeros(0, np.uint64)
    word, first = word_hashes(data, bounds, ~_space)
    full = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        full += word[k: k + len(full)] * _odd[k % 5]
    full = splitmix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(full[a: b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for k in range(a, b):
                h = splitmix(np.array([h]) * _odd[0] + word[k])[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(none)
    return out


def _each_slice(column, words: int):
    """(first row, sets) over slices of an Arrow string column."""
    data, bounds = text_bytes(column)
    for first, last in slices(bounds, SLICE):
        yield first, shingles(data[bounds[first]: bounds[last]], bounds[first: last + 1] - bounds[first], words)


def prefix_length(n: int) -> int:
    """How many of a set's first shingles hold one of any set similar to it."""
    return n - (4 * n + 4) // 5 + 1


def linked(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= 80 * (a + b - shared)


def group_counts(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=GROUPS)


def fine_counts(s: np.ndarray) -> np.ndarray:
    """Counts, a byte each, in more groups the more shingles there are; each group of a coarser division is a run of these."""
    bits = min(max(7, (len(s) // 8).bit_length()), 24)
    while True:
        counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        bits += 1


def fine_bound(a: np.ndarray, b: np.ndarray) -> int:
    """``bound`` at the coarser of two divisions."""
    g = min(len(a), len(b))
    return int(np.minimum(a.reshape(g, -1).sum(1), b.reshape(g, -1).sum(1)).sum())


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most shingles that sets with these group counts can share."""
    return np.minimum(a, b).sum(-1)


class Tree:
    """A packed R-tree over count vectors, with each node's largest coordinates and range of sizes."""

    def __init__(self, points: np.ndarray, owner: np.ndarray):
        sizes = points.sum(1)
        # neighbours in size, then in the coordinates, share a node
        order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.items = order
        owner = owner[order]
        self.levels = [(points[order], sizes[order], sizes[order], owner, owner)]
        while len(self.levels[-1][0]) > FAN:
            top, small, large, low, high = self.levels[-1]
            cut = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(small, cut), np.maximum.reduceat(large, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, points: np.ndarray, owner: np.ndarray, batch: int = 64):
        """Pairs (query, item) of different owners that may be similar, by size and bound, a batch of queries at a time."""
        for lo in range(0, len(points), batch):
            own, n = points[lo: lo + batch], points[lo: lo + batch].sum(1)
            q = np.repeat(np.arange(len(own)), len(self.levels[-1][0]))
            node = np.tile(np.arange(len(self.levels[-1][0])), len(own))
            for depth in range(len(self.levels) - 1, -1, -1):
                top, small, large, low, high = self.levels[depth]
                if depth < len(self.levels) - 1:
                    q, node = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                    q, node = q[node < len(top)], node[node < len(top)]
                same = (low[node] == high[node]) & (low[node] == owner[lo + q])
                fits = ~same & (5 * large[node] >= 4 * n[q]) & (5 * n[q] >= 4 * small[node])
                q, node = q[fits], node[fits]
                parts = [9 * bound(own[q[i: i + 65536]], top[node[i: i + 65536]]) >= 4 * (n[q[i: i + 65536]] + small[node[i: i + 65536]]) for i in range(0, len(q), 65536)]
                fits = np.concatenate(parts) if parts else np.zeros(0, bool)
                q, node = q[fits], node[fits]
            yield q + lo, self.items[node]


def _names(sets: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
    """128-bit digests that name sets, and their first halves as numbers."""
    import xxhash

    names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    return names, np.frombuffer(b"".join(names), ">u8").astype(np.uint64)[::2].view(np.int64)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: its ids, its set's name, node (half of the name), size and count vectors."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first, sets in _each_slice(b.column(3), words):
                m = len(sets)
                names, nodes = _names(sets)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(first, m) for i in range(3)), pa.array(names, pa.binary()), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array([group_counts(s).astype("<u4").tobytes() for s in sets], pa.binary()), pa.array([fine_counts(s).tobytes() for s in sets], pa.binary())],
                    ["doc_id", "key_a", "key_b", "set", "node", "n", "point", "fine"])

    return docs.select("doc_id", "key_a", "key_b", "text").mapInArrow(run, "doc_id long, key_a long, key_b long, set binary, node long, n long, point binary, fine binary")


class Order:
    """The order of shingles: by hash, those in more than ``FREQUENT`` documents last.

    Frequent shingles are told by the first ``bits + 24`` bits of their hash; any
    fixed order is right.
    """

    def __init__(self, bits: int, listed: np.ndarray):
        self.shift, self.listed = np.uint64(40 - bits), np.sort(listed)

    def often(self, h: np.ndarray) -> np.ndarray:
        if not len(self.listed):
            return np.zeros(len(h), bool)
        top = h >> self.shift
        return self.listed[np.minimum(np.searchsorted(self.listed, top), len(self.listed) - 1)] == top


def _shingle_order(docs: DataFrame, total: int, words: int) -> Order:
    """Count all documents' shingles, packed by ranges of their hashes, and list the frequent ones."""
    bits = max(10, int(total / 500_000).bit_length())
    shift = np.uint64(40 - bits)

    def deal(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = (key >> np.uint64(24)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = [*cut[1:].tolist(), len(key)]
            low, n = key.astype("<u4").view(np.uint8).reshape(-1, 4), np.minimum(n, 255).astype(np.uint8)
            # sorted numbers byte by byte: their high bytes run on and compress
            keys = [low[x:y, 2::-1].T.tobytes() for x, y in zip(cut.tolist(), ends)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(keys, pa.binary()), pa.array([n[x:y].tobytes() for x, y in zip(cut.tolist(), ends)], pa.binary())], ["bucket", "keys", "counts"])

        for b in batches:
            for _, sets in _each_slice(b.column(0), words):
                for s in sets:
                    held.append(s >> shift)
                    size += len(s)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def gather(batches):
        import pyarrow as pa

        def block(bucket, keys, counts):
            k, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
            order = np.argsort(k, kind="stable")
            k, n = k[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            n = np.add.reduceat(n, first)
            many = n > FREQUENT
            return pa.RecordBatch.from_arrays([pa.array((bucket << 24) + k[first][many]), pa.array(n[many])], ["top", "in_docs"])

        bucket, keys, counts = None, [], []
        for b in batches:
            for at, x, y in zip(*(c.to_pylist() for c in b.columns)):
                if at != bucket and keys:
                    yield block(bucket, keys, counts)
                    keys, counts = [], []
                bucket = at
                high, middle, low = np.frombuffer(x, np.uint8).reshape(3, -1).astype(np.int64)
                keys.append(high << 16 | middle << 8 | low)
                counts.append(np.frombuffer(y, np.uint8))
        if keys:
            yield block(bucket, keys, counts)

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * BUCKET)))
    dealt = docs.select("text").mapInArrow(deal, "bucket long, keys binary, counts binary")
    counted = written(dealt.repartition(int(tasks), "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "top long, in_docs long"), "frequent")
    # as many of the most frequent as the list holds, by a histogram of at most a few hundred rows
    level = F.floor(F.log2("in_docs") * 8)
    room, least = LIST, None
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > room:
            break
        room, least = room - r["count"], r["level"]
    if least is None:
        return Order(bits, np.zeros(0, np.uint64))
    found = counted.where(level >= least).select("top").toArrow()  # at most ``LIST`` numbers
    return Order(bits, found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _entries(docs: DataFrame, shingle_order: Order, total: int, words: int) -> DataFrame:
    """The blocks with several members: a small one whole (h null, nodes), of others a member a row (h, nodes with one entry)."""
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET))
    sent = docs.sparkSession.sparkContext.broadcast(shingle_order)

    def deal(batches):
        import pyarrow as pa

        last = sent.value
        held_h, held_c, size, seen = [], [], 0, set()

        def flush():
            h, c = np.concatenate(held_h), np.concatenate(held_c)
            often = last.often(h)
            # blocks of frequent shingles stay spread over the buckets by member
            to = (np.where(often, splitmix(c.view(np.uint64)), h) % np.uint64(buckets)).astype(np.int64) * 2 + often
            order = np.argsort(to, kind="stable")
            to, h, c = to[order], h[order], c[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            ends = [*cut[1:].tolist(), len(to)]
            return pa.RecordBatch.from_arrays(
                [pa.array(to[cut]), pa.array([h[a:b].tobytes() for a, b in zip(cut.tolist(), ends)], pa.binary()), pa.array([c[a:b].tobytes() for a, b in zip(cut.tolist(), ends)], pa.binary())], ["bucket", "h", "nodes"])

        for b in batches:
            for _, sets in _each_slice(b.column(0), words):
                for s, own in zip(sets, _names(sets)[1].tolist()):
                    if not len(s) or own in seen:
                        continue
                    seen.add(own)
                    p = prefix_length(len(s))
                    often = last.often(s)
                    s = np.concatenate([s[~often][:p], s[often][:p]]) if often.any() else s
                    held_h.append(s[:p])
                    held_c.append(np.full(p, own, np.int64))
                    size += p
                if size > 1_000_000:
                    yield flush()
                    held_h, held_c, size, seen = [], [], 0, set()
        if size:
            yield flush()

    def gather(batches):
        import pyarrow as pa

        def emit(h, values, width):
            for lo in range(0, len(values), 65_536 * width):
                part = values[lo: lo + 65_536 * width]
                rows = len(part) // width
                nodes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) + 1, width, np.int32)), pa.array(part))
                yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()) if h is None else pa.array(h[lo: lo + rows].view(np.int64)), nodes], ["h", "nodes"])

        def block(h, c, often):
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            h, c = h[new], c[new]
            if often:
                yield from emit(h, c, 1)
                return
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([first, [len(h)]]))
            for k in range(2, NODE + 1):  # whole blocks; many have the same members, of which one is enough
                lists = c[first[size == k][:, None] + np.arange(k)]
                if len(lists):
                    yield from emit(None, np.unique(lists, axis=0).ravel(), k)
            large = np.repeat(size > NODE, size)
            yield from emit(h[large], c[large], 1)

        bucket, h, c = None, [], []
        for b in batches:
            for k, x, y in zip(*(col.to_pylist() for col in b.columns)):
                if k != bucket and h:
                    yield from block(np.concatenate(h), np.concatenate(c), bool(bucket % 2))
                    h, c = [], []
                bucket = k
                h.append(np.frombuffer(x, np.uint64))
                c.append(np.frombuffer(y, np.int64))
        if h:
            yield from block(np.concatenate(h), np.concatenate(c), bool(bucket % 2))

    dealt = docs.select("text").mapInArrow(deal, "bucket long, h binary, nodes binary")
    return dealt.repartition(int(buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "h long, nodes array<long>")


def _may_be_similar(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and the bound on the shared shingles allow."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fits = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
                n, m = int(x.sum()), int(y.sum())
                fits.append(5 * n >= 4 * m and 5 * m >= 4 * n and 9 * fine_bound(x, y) >= 4 * (n + m))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fits, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    a, b = points.select(F.col("node").alias("a"), F.col("fine").alias("x")), points.select(F.col("node").alias("b"), F.col("fine").alias("y"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _tiled(members: DataFrame, key: str, weight: str, limit: int) -> DataFrame:
    """``members`` (key, node, n, weight, ..) once for each tile (i, j) they belong to, with their own slot.

    A group of at most ``limit`` weight is one tile. A larger one is split by
    size and then by hash, and slots meet where their sizes can be similar.
    """
    total = members.groupBy(key).agg(F.sum(weight).alias("_total"))
    sized = members.join(total, key)
    zero = F.lit(0).cast("long")
    one = sized.where(F.col("_total") <= limit).select("*", zero.alias("slot"), zero.alias("i"), zero.alias("j"))
    large = sized.where(F.col("_total") > limit).withColumn("_step", F.floor(F.log("n") / math.log(STEP)))
    steps = large.groupBy(key, "_step").agg(F.ceil(F.sum(weight) / limit).alias("slots"))
    # at most a row for each step between the smallest and the largest set
    steps = steps.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_step", "slots"))).alias("_slots"))
    slots = lambda step: F.coalesce(F.try_element_at("_slots", step), F.lit(0)).cast("int")
    own = large.join(steps, key).withColumn("slot", F.shiftleft("_step", 32) + F.pmod(F.xxhash64("node", key), slots(F.col("_step"))))

    def of_step(step):
        return F.transform(F.slice(F.sequence(F.lit(1), F.greatest(slots(step), F.lit(1))), 1, slots(step)), lambda k: F.shiftleft(step, 32) + k - 1)

    beside = F.flatten(F.array(*(of_step(F.col("_step") + d) for d in (-1, 0, 1))))
    other = own.withColumn("_other", F.explode(beside)).select("*", F.least("slot", "_other").alias("i"), F.greatest("slot", "_other").alias("j")).drop("_step", "_slots", "_other")
    return one.unionByName(other).drop("_total")


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (x, smallest that x reaches) that connect what the edges (a, b) connect."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            break
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(ids))
    return np.stack([ids[moved], ids[label[moved]]], 1)


def _between(sized: DataFrame, points: DataFrame) -> DataFrame:
    """Edges (a, b) between components that connect those with members in one block which the bounds allow to be similar.

    ``sized`` has h, node, n and component; ``points`` each node's counts. Blocks beyond ``TILE`` members are compared tile by tile.
    """
    tiles = _tiled(sized.withColumn("one", F.lit(1)), "h", "one", TILE)
    tiled = tiles.join(points.select("node", "point", "fine"), "node").select("h", "i", "j", "slot", "component", "point", "fine")

    def run(batches):
        import pyarrow as pa

        def by_fine_counts(fine):
            """A function of pairs of members: which ones the fine counts allow."""
            counts = [np.frombuffer(f, np.uint8) for f in fine]
            groups, n = np.array([len(c) for c in counts]), np.array([c.sum(dtype=np.int64) for c in counts], np.int64)
            folds: dict[int, tuple] = {}

            def fold(g):
                if g not in folds:
                    at = np.flatnonzero(groups >= g)
                    folds[g] = np.stack([counts[k].reshape(g, -1).sum(1).astype(np.uint16) for k in at]), np.searchsorted(at, np.arange(len(groups)))
                return folds[g]

            def allowed(x, y):
                most, common = np.zeros(len(x), np.int64), np.minimum(groups[x], groups[y])
                for g in np.unique(common).tolist():
                    folded, row = fold(g)
                    step, own = max(1, 1_000_000 // g), np.flatnonzero(common == g)
                    for lo in range(0, len(own), step):
                        k = own[lo: lo + step]
                        most[k] = bound(folded[row[x[k]]], folded[row[y[k]]])
                return (5 * n[x] >= 4 * n[y]) & (5 * n[y] >= 4 * n[x]) & (9 * most >= 4 * (n[x] + n[y]))

            return allowed

        def of_block(i, j, slot, owner, points, fine):
            """Edges between the owners of one block or tile; who is joined already is not compared again."""
            ids, label = np.unique(owner, return_inverse=True)
            allowed, found = by_fine_counts(fine), []

            def connect(x, y):
                nonlocal label
                if len(x):
                    edges = spanning(label[x], label[y])
                    if len(edges):
                        found.append(np.stack([ids[edges[:, 0]], ids[edges[:, 1]]], 1))
                        to = np.arange(len(ids))
                        to[edges[:, 0]] = edges[:, 1]
                        label = to[label]

            def common():
                return np.bincount(label, minlength=len(ids)).argmax()

            centre = np.flatnonzero(label == common())[0]
            rest = np.flatnonzero(label != label[centre])
            fits = allowed(rest, np.full(len(rest), centre))
            connect(rest[fits], np.full(fits.sum(), centre))
            left, right = np.flatnonzero(slot == i), np.flatnonzero(slot == j)
            if not len(left) or not len(right):
                return found
            at, step, tree = 0, 64, None
            while at < len(left):
                if label.min() == label.max():
                    break
                if tree is None or len(found) > seen:
                    tree, seen = Tree(points[right], label[right]), len(found)
                ask = left[at: at + step]
                if i == j:  # the largest component has the tree to itself and need not ask
                    ask = ask[label[ask] != common()]
                for q, r in tree.search(points[ask], label[ask]):
                    x, y = ask[q], right[r]
                    fits = allowed(x, y)
                    connect(x[fits], y[fits])
                at += step
                step = min(2 * step, 1024)
            return found

        def edges(columns):
            """Edges of whole blocks."""
            h, i, j, slot, owner, points, fine = columns
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            size = np.diff(np.concatenate([new, [len(h)]]))
            n = points.sum(1, dtype=np.int64)
            left, right = [], []
            # blocks that fill one node: every pair, all blocks at once
            place = np.arange(len(h)) - np.repeat(new, size)
            room = np.where(np.repeat(size, size) <= NODE, np.repeat(size, size) - place, 0)
            for k in range(1, NODE):
                x = np.flatnonzero(room > k)
                if not len(x):
                    break
                y = x + k
                fits = (owner[x] != owner[y]) & (5 * n[x] >= 4 * n[y]) & (5 * n[y] >= 4 * n[x])
                x, y = x[fits], y[fits]
                m = np.concatenate([bound(points[x[c: c + 65536]], points[y[c: c + 65536]]) for c in range(0, len(x), 65536)] or [np.zeros(0)]).astype(np.int64)
                fits = 9 * m >= 4 * (n[x] + n[y])
                left.append(x[fits])
                right.append(y[fits])
            out = []
            if left and len(x := np.concatenate(left)):
                y = np.concatenate(right)
                used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                fits = by_fine_counts(fine[used])(at[: len(x)], at[len(x):])
                out.append(spanning(owner[x[fits]], owner[y[fits]]))
            for lo, k in zip(new[size > NODE].tolist(), size[size > NODE].tolist()):
                own = slice(lo, lo + k)
                out += of_block(i[lo], j[lo], slot[own], owner[own], points[own].astype(np.int64), fine[own])
            return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

        def emit(found):
            both = np.concatenate(found)
            both = spanning(both[:, 0], both[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        held, found, size = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            columns = [np.asarray(b.column(k)) for k in range(5)] + [np.frombuffer(b"".join(b.column(5).to_pylist()), "<u4").reshape(-1, GROUPS), np.array([*b.column(6).to_pylist(), None], object)[:-1]]
            if held is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(held, columns)]
            h, i, j = columns[:3]
            last = int(np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))[-1])
            held = [c[last:] for c in columns]  # the last block may go on
            if last:
                found.append(edges([c[:last] for c in columns]))
                size += len(found[-1])
            if size > 500_000:
                yield emit(found)
                found, size = [], 0
        if held is not None:
            found.append(edges(held))
        if found:
            yield emit(found)

    return tiled.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(run, "a long, b long")


class Index:
    """Which of some sets hold each shingle."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        h = np.concatenate([sets[k] for k in members])
        order = np.argsort(h, kind="stable")
        self.h, self.total = h[order], len(sets)
        self.owner = np.repeat(members, [len(sets[k]) for k in members])[order]
        new = np.concatenate([[True], self.h[1:] != self.h[:-1]]) if len(h) else np.zeros(0, bool)
        self.first = np.concatenate([np.flatnonzero(new), [len(h)]])
        self.h = self.h[new]

    def shared(self, s: np.ndarray) -> np.ndarray:
        """How many shingles each set has in common with ``s``."""
        at = np.searchsorted(self.h, s)
        at[at == len(self.h)] = 0
        at = at[self.h[at] == s] if len(self.h) else at[:0]
        if not len(at):
            return np.zeros(self.total, np.int64)
        return np.bincount(np.concatenate([self.owner[a:b] for a, b in zip(self.first[at].tolist(), self.first[at + 1].tolist())]), minlength=self.total)


def related(sets: list[np.ndarray], count: bool, apart: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each set's component, by number of a member, and with ``count`` its number of links.

    With ``apart`` the first so many sets are compared with the others alone.
    Where links are not counted, a set that is placed is not looked up again.
    """
    m, n = len(sets), np.array([len(s) for s in sets])
    label, links = np.arange(m), np.zeros(m, np.int64)
    if m == 2:
        if linked(len(np.intersect1d(sets[0], sets[1], True)), *n.tolist()):
            label[:], links[:] = 0, 1
    elif count:
        index = Index(sets, np.arange(apart, m))
        for x in range(apart or m):
            similar = np.flatnonzero(linked(index.shared(sets[x]), n[x], n))
            similar = similar[similar != x]
            links[x] += len(similar)
            if apart:
                links[similar] += 1
            if len(similar) and (label[similar] != label[x]).any():
                joined = np.unique(np.append(label[similar], label[x]))
                label[np.isin(label, joined)] = joined[0]
    else:
        left, held = np.ones(m, bool), m
        index = Index(sets, np.arange(m))
        for start in range(m):
            if not left[start]:
                continue
            left[start], queue = False, [start]
            while queue:
                x = queue.pop()
                fits = np.flatnonzero(left & linked(index.shared(sets[x]), n[x], n))
                label[fits], left[fits] = start, False
                queue += fits.tolist()
                if 2 * left.sum() < held and left.any():
                    index, held = Index(sets, np.flatnonzero(left)), int(left.sum())
                if not left.any():
                    break
    return label, links


def _compared(members: DataFrame, docs: DataFrame, words: int, count: bool) -> DataFrame:
    """(set, label, links) of each member of a cluster, for each tile it is in: the smallest set its links reach there.

    ``members`` has cluster, node, set, n and key_a, key_b of a row of ``docs`` with its text.
    """
    tiled = _tiled(members, "cluster", "n", TILE_SHINGLES)
    # rows equal in id and text share a key; one of them is enough
    texts = docs.select("key_a", "key_b", "text").join(members.select("key_a", "key_b"), ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"])
    own = tiled.join(texts, ["key_a", "key_b"]).select("cluster", "i", "j", "slot", "set", "text")

    def run(batches):
        import pyarrow as pa

        key, held, found, size = None, [], [], 0

        def compared():
            i, j = key[1:]
            held.sort(key=lambda r: r[0] != i)
            names, sets = [r[1] for r in held], [r[2] for r in held]
            apart = sum(r[0] == i for r in held) if i != j else 0
            if i != j and apart in (0, len(held)):  # nobody on one side
                return
            label, links = related(sets, count, apart)
            least: dict[int, bytes] = {}
            for k, name in zip(label.tolist(), names):
                least[k] = min(name, least.get(k, name))
            found.append((names, [least[k] for k in label.tolist()], links))

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f[0]], pa.binary()), pa.array([x for f in found for x in f[1]], pa.binary()), pa.array(np.concatenate([f[2] for f in found]))], ["set", "label", "links"])

        for b in batches:
            sets = (s for _, x in _each_slice(b.column(5), words) for s in x)
            for *now, slot, name, s in zip(*(b.column(k).to_pylist() for k in range(5)), sets):
                if now != key and held:
                    compared()
                    size += len(held)
                    held = []
                    if found and size > 100_000:
                        yield emit()
                        found, size = [], 0
                key = now
                held.append((slot, name, s))
        if held:
            compared()
        if found:
            yield emit()

    return own.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(run, "set binary, label binary, links long")


def _placed(keyed: DataFrame, words: int, count: bool = False) -> DataFrame:
    """(doc_id, key_a, key_b, n, set, component, component_id) of each row of ``keyed`` (doc_id, text, key_a, key_b), and with ``count`` links."""
    sets = written(_sets(keyed, words), "sets")
    classes = written(sets.where("n > 0").groupBy("set").agg(F.first("node").alias("node"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("fine").alias("fine"), F.min("doc_id").alias("doc_id"), F.min(F.struct("key_a", "key_b")).alias("one")), "classes")
    first_ones, total = classes.agg(F.sum(F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1), F.sum("n")).first()
    entries = written(_entries(keyed, _shingle_order(keyed, int(total or 0), words), int(first_ones or 0), words), "entries")
    points = classes.select("node", "n", "point", "fine")

    # most clusters show when each member of a block is compared with the first one
    small = written(entries.where("h is null").select("nodes").distinct(), "small")
    large = entries.where("h is not null").select("h", F.col("nodes")[0].alias("node"))
    centre = large.groupBy("h").agg(F.min("node").alias("b"), F.count("*").alias("members")).where("members > 1")
    pairs = small.select(F.explode(F.slice("nodes", 2, NODE)).alias("a"), F.col("nodes")[0].alias("b"))
    pairs = pairs.unionByName(large.join(centre, "h").where("node != b").select(F.col("node").alias("a"), "b")).distinct()
    reached = components(written(_may_be_similar(pairs, points), "near"))

    # then only blocks with members of several clusters are searched
    member = small.select(F.xxhash64("nodes").alias("h"), F.explode("nodes").alias("node")).unionByName(large)
    known = points.select("node", "n").join(reached, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    placed = written(member.join(known, "node"), "placed")
    several = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("h")
    edges = written(_between(placed.join(several, "h", "left_semi"), points), "near")
    further = components(edges).select(F.col("node").alias("component"), F.col("component").alias("further"))
    for old in (entries, small, placed):
        drop(old)

    named = classes.select("set", "node", "n", "doc_id", "one.*").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named.join(further, "component", "left").withColumn("cluster", F.coalesce("further", "component")).drop("component", "further"), "clusters")
    lone = named.groupBy("cluster").agg(F.count("*").alias("sets")).where("sets > 1").select("cluster")
    found = written(_compared(named.join(lone, "cluster", "left_semi"), keyed, words, count), "compared")
    by_tile = found.groupBy("set").agg(F.sum("links").alias("links"), F.min("label").alias("component"), F.count_distinct("label").alias("labels"))
    # sets of one tile are placed by it; those that met others in several need the tiles put together
    across = found.where("set != label").select(F.col("set").alias("a"), F.col("label").alias("b"))
    if by_tile.where("labels > 1").isEmpty():
        placed_sets = by_tile.select("set", "links", "component")
    else:
        whole = components(across)
        placed_sets = by_tile.select("set", "links").join(whole.select(F.col("node").alias("set"), "component"), "set", "left")
    by_class = named.select("set", "doc_id").join(placed_sets, "set", "left").select("set", "doc_id", "links", F.coalesce("component", "set").alias("component"))
    smallest = by_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    told = by_class.join(smallest, "component").select("set", "component", "component_id", "links")
    out = sets.select("doc_id", "key_a", "key_b", "n", F.when(F.col("n") > 0, F.col("set")).alias("set"))
    return out.join(told, "set", "left")


def join(docs: DataFrame, words: int = WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, links.

    ``component_id`` is the smallest doc_id among the documents that links
    reach, the document included; null ids are passed over, and a component
    without any id has null. ``links`` counts all sets other than the
    document's own that are similar to it. A null text or one
    without words has an empty set and stands alone. Equal sets are similar
    whatever the texts. Repeated rows give one row each; other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _placed(docs.select("doc_id", "text", *row_key("doc_id", "text")), words, count=True)
    empty = F.col("n") == 0
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, a null id only where there is no other.

    Of rows equal in id and text one stays if it is the component's. Documents
    with an empty set are similar to nothing, so all of them stay.
    """
    keyed = docs.select(F.struct("*").alias("row"), *row_key("doc_id", "text"))
    found = _placed(keyed.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "key_a", "key_b"), words)
    ranked = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_a", "key_b")
    winners = found.where("n > 0").groupBy("component").agg(F.min(ranked).alias("one")).select("one.key_a", "one.key_b")
    empty = found.where("n = 0").select("key_a", "key_b").distinct()
    one = keyed.join(winners, ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"])
    return one.unionByName(keyed.join(empty, ["key_a", "key_b"], "left_semi")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"))
