"""Operator 7: approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected to DIMENSIONS Gaussian (2-stable) directions, so that the squared distance of two
projections, divided by the squared distance of the vectors, has the chi-square distribution. A kd-tree over the
projections has two parts. Its top, at most TOP_CELLS cells, is fitted on a sample of at most TOP_SAMPLE vectors,
those of least hashed id; every vector goes to its cell. A cell of more than SHARD vectors, such as one of many
copies, is dealt out to as many shards by the id's hash. Each shard has the rest of the tree over its own vectors.

A query goes down the trees best first: of the nodes that it has come to it opens those whose boxes are nearest
to its own projection, and verifies the vectors of the leaves among them. It drops a node or a shard once the test holds: a
vector at the K-th distance found so far would, with a chance of CERTAIN or more, have a projection nearer than
the box. The test bounds the expected share of true neighbours found from below. Queries are those rows whose id
is divisible by `every`, against all rows. Queries of a cell are asked together, in blocks, and a block reads a
shard only if one of its queries can't drop it.

Where neighbours are hardly nearer than other vectors (as in the supplied random embeddings), the test holds
late, and most vectors are verified; where they come in clusters, few are.

Rows that `vectors.clean` leaves out are neither queries nor answers. Vectors that are the same are each other's
neighbours at distance 0; ties go by id. Fewer than K other vectors give as many rows; an empty table gives none.
Columns other than the two that are named aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

K = 10
DIMENSIONS = 8
CERTAIN = 0.92
SHARD = 16384
LEAF = 64
BLOCK = 2048
#: Queries of a task; it holds one block of them and one shard at a time.
TASK_QUERIES = 8192
TOP_SAMPLE, TOP_CELLS = 65_536, 2048
SEED = 20240
EVERY = 20


def directions(length: int, m: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((length, m)).astype(np.float32)


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """The chi-square distribution function, for an even m."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(certain: float, m: int) -> float:
    """Where the distribution function reaches `certain`."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < certain else (low, mid)
    return high


def kd_tree(p: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The rows of p in order of their leaves, and the nodes: halved at the median of the widest direction.

    A node has its children (-1: a leaf), its rows' places from begin to before end, and its box; node 0 is the root.
    """
    order = np.arange(len(p))
    nodes, todo = [[-1, -1, 0, len(p)]], [0]
    while todo:
        n = todo.pop()
        _, _, lo, hi = nodes[n]
        if hi - lo <= leaf:
            continue
        at = order[lo:hi]
        part = p[at]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        mid = (hi - lo) // 2
        order[lo:hi] = at[np.argpartition(part[:, axis], mid)]
        for side, (a, b) in enumerate(((lo, lo + mid), (lo + mid, hi))):
            nodes[n][side] = len(nodes)
            todo.append(len(nodes))
            nodes.append([-1, -1, a, b])
    left, right, begin, end = np.array(nodes).T
    low, high = (np.stack([f(p[order[a:b]], axis=0) for a, b in zip(begin, end)]) for f in (np.min, np.max))
    return order, {"left": left, "right": right, "begin": begin, "end": end, "low": low, "high": high}


def box_distance(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of points p from boxes."""
    gap = np.maximum(np.maximum(low - p, p - high), 0)
    return (gap * gap).sum(-1)


class Top:
    """The top of the tree: cells by medians of a sample, halved along the widest direction."""

    def __init__(self, p: np.ndarray, cells: int):
        self.depth = max(0, int(cells - 1).bit_length())
        while self.depth and len(p) < 1 << self.depth:
            self.depth -= 1
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth, np.float32)
        parts = {1: p}
        for node in range(1, 1 << self.depth):
            part = parts.pop(node)
            if len(part):
                self.axis[node] = np.argmax(part.max(0) - part.min(0))
                self.cut[node] = np.median(part[:, self.axis[node]])
            right = part[:, self.axis[node]] > self.cut[node]
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


def build(ids: np.ndarray, x: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A shard's tree with its vectors, and its box."""
    order, tree = kd_tree(x @ directions(x.shape[1]))
    return vectors.pack(ids=ids[order], x=x[order], **tree), tree["low"][0], tree["high"][0]


class Nearest:
    """The nearest so far of a block of queries, over the shards that were asked."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int = K, certain: float = CERTAIN, m: int = DIMENSIONS):
        self.own, self.x, self.k, self.m = ids, x, k, m
        self.ratio = quantile(certain, m)
        self.p, self.norm = x @ directions(x.shape[1], m), (x * x).sum(1)
        self.distance = np.full((len(x), k), np.inf, np.float32)
        self.ids = np.full((len(x), k), np.iinfo(np.int64).max)
        self.verified = 0

    def dropped(self, bound: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Whether the test holds for boxes at this distance."""
        return (bound > 0) & (bound >= self.ratio * kth)

    def order(self, low: np.ndarray, high: np.ndarray) -> Iterator[int]:
        """The boxes that a query may need, nearest to the block first."""
        bound = (np.maximum(np.maximum(low - self.p.max(0), self.p.min(0) - high), 0) ** 2).sum(1)
        for i in np.argsort(bound, kind="stable"):
            if self.dropped(bound[i], self.distance[:, -1].max()):
                return
            if not self.dropped(box_distance(self.p, low[i], high[i]), self.distance[:, -1]).all():
                yield int(i)

    def ask(self, shard: dict[str, np.ndarray]) -> None:
        ids, x, left, right, begin, end, low, high = (shard[k] for k in ("ids", "x", "left", "right", "begin", "end", "low", "high"))
        norm, leaf = (x * x).sum(1), left < 0
        widest = int((end - begin)[leaf].max())
        n = len(self.x)
        # Each query's nodes that aren't open yet; opening one puts its children in its place and at the end.
        bound, node, count = np.full((n, int(leaf.sum())), np.inf, np.float32), np.zeros((n, int(leaf.sum())), np.int32), np.ones(n, np.int64)
        bound[:, 0] = box_distance(self.p, low[0], high[0])
        active, step = np.arange(n), 1
        while len(active):
            used = int(count[active].max())
            take = min(step, used)
            near = bound[active, :used]
            pick = np.argpartition(near, take - 1, axis=1)[:, :take] if take < used else np.tile(np.arange(used), (len(active), 1))
            near = np.take_along_axis(near, pick, 1)
            good = np.isfinite(near) & ~self.dropped(near, self.distance[active, -1:])
            on = good.any(1)
            active, pick, good = active[on], pick[on], good[on]
            if not len(active):
                break
            chosen = node[active[:, None], pick]
            bound[active[:, None], pick] = np.inf
            row, place = np.nonzero(good & ~leaf[chosen])
            if len(row):
                at, whose = chosen[row, place], active[row]
                behind = np.arange(len(row)) - np.searchsorted(row, row)
                for slot, child in ((pick[row, place], left[at]), (count[whose] + behind, right[at])):
                    node[whose, slot] = child
                    bound[whose, slot] = box_distance(self.p[whose], low[child], high[child])
                count += np.bincount(whose, minlength=n)
            row, place = np.nonzero(good & leaf[chosen])
            if len(row):
                self._verify(active, row, place, chosen[row, place], chosen.shape[1], widest, ids, x, norm, begin, end)
            step = min(2 * step, 32)

    def _verify(self, active, row, place, leaves, width: int, widest: int, ids, x, norm, begin, end) -> None:
        """Take the vectors of leaves into the nearest of queries active[row]."""
        asked, row = np.unique(row, return_inverse=True)
        active = active[asked]
        found = np.full((len(active), width, widest), np.inf, np.float32)
        names = np.full(found.shape, np.iinfo(np.int64).max)
        order = np.argsort(leaves, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(leaves[order]) != 0]))
        for i, j in zip(cuts, np.append(cuts[1:], len(order))):
            at = order[i:j]
            lo, hi = begin[leaves[at[0]]], end[leaves[at[0]]]
            q = active[row[at]]
            found[row[at], place[at], : hi - lo] = self.norm[q][:, None] + norm[lo:hi] - 2 * (self.x[q] @ x[lo:hi].T)
            names[row[at], place[at], : hi - lo] = ids[lo:hi]
            self.verified += len(q) * int(hi - lo)
        found, names = found.reshape(len(active), -1), names.reshape(len(active), -1)
        found[names == self.own[active][:, None]] = np.inf
        np.maximum(found, 0, out=found)
        both = np.concatenate([self.distance[active], found], 1)
        name = np.concatenate([self.ids[active], names], 1)
        # All that are as near as the k-th: ties go by id.
        kth = np.partition(both, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        most = int((both <= kth).sum(1).max()) if np.isfinite(kth).all() else both.shape[1]
        near = np.argpartition(both, most - 1, axis=1)[:, :most]
        both, name = np.take_along_axis(both, near, 1), np.take_along_axis(name, near, 1)
        sort = np.lexsort((name, both), axis=1)[:, : self.k]
        self.distance[active], self.ids[active] = np.take_along_axis(both, sort, 1), np.take_along_axis(name, sort, 1)


def nearest(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = K, certain: float = CERTAIN, shard: int = SHARD, every: int = 1, sample: int = TOP_SAMPLE) -> DataFrame:
    """(id, rank, neighbour, distance): the k nearest others, by Euclidean distance, of each row whose id is divisible by `every`."""
    spark = rows.sparkSession
    scratch = common.Scratch(spark, "annkd")
    held = scratch.write(vectors.clean(rows, ident, vector), "vectors")
    cells = min(TOP_CELLS, vectors.shards_of(held.count(), shard))
    some = held.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v") if cells > 1 else None
    x = vectors.matrix(some) if some is not None else np.zeros((0, 1), np.float32)
    top = Top(x @ directions(x.shape[1]), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column(1))
            cell = top.cell(x @ directions(x.shape[1])) if top.depth and len(x) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    placed = held.mapInArrow(place, "id long, v array<float>, cell int")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    first, parts, n = {}, {}, 0
    for cell in sorted(sizes):
        first[cell], parts[cell] = n, vectors.shards_of(sizes[cell], shard)
        n += parts[cell]
    # Two small tables of at most TOP_CELLS entries, by cell.
    begin, many = (F.create_map(*[F.lit(int(x)) for kv in t.items() for x in kv]) if t else F.create_map().cast("map<int,int>") for t in (first, parts))
    numbered = placed.withColumn("shard", begin[F.col("cell")] + F.pmod(F.xxhash64("id"), many[F.col("cell")]).cast("int"))
    path = vectors.build_boxes(numbered, build, scratch, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = None
        for ids, x in vectors.blocks(batches, BLOCK):
            boxes = boxes or vectors.read_boxes(path)
            shards, files, low, high = boxes
            b = Nearest(ids, x, k, certain)
            for i in b.order(low, high):
                b.ask(vectors.read_shard(path, files[i], int(shards[i])))
            row, rank = np.nonzero(np.isfinite(b.distance))
            yield pa.RecordBatch.from_arrays([pa.array(b.own[row]), pa.array((rank + 1).astype(np.int32)), pa.array(b.ids[row, rank]), pa.array(np.sqrt(b.distance[row, rank].astype(float)))], names=["id", "rank", "neighbour", "distance"])

    asked = placed.where(F.pmod("id", F.lit(every)) == 0)
    tasks = max(common.partitions(spark), -(-sum(sizes.values()) // (every * TASK_QUERIES)))
    return asked.repartitionByRange(tasks, "cell", "id").select("id", "v").mapInArrow(run, "id long, rank int, neighbour long, distance double")


def query(spark, sf_dir: str) -> DataFrame:
    """The K nearest of every embedding whose id is divisible by EVERY, among all embeddings."""
    return nearest(common.table(spark, sf_dir, "embeddings"), every=EVERY).withColumnRenamed("id", "vec_id")
