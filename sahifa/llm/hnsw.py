"""Operator 4: near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors are normalised, and split into shards of up to SHARD by their id's hash. Each shard has a graph: every
vector is in layer 0, one in M of a layer is in the one above, and a vector's links are the nearest that aren't
nearer to a link it has already. A search goes down from the top and keeps a beam in layer 0.

The beam's width is set by audit, shard by shard: one vector in AUDIT (at least AUDIT_LEAST) is turned to the
threshold's angle in a random direction, and the beam is widened by half until searches find RECALL of all that brute
force finds for these probes, in all and in the mean of each, without those of full beams; if no beam does, the shard is searched by brute force. Every vector asks every
shard, in blocks: a task holds a block and a shard at a time. A query whose beam has only near-duplicates in it may have missed some, and is done again by brute force
in that shard, so large groups aren't cut off. What is found is verified by its cosine, linked, and unioned to
connected components; of each the least id stays.

Every vector gets its class, the least id of its component, and its links, the number of other vectors that are
near it. Vectors that are the same bit for bit are one in the graphs, so that copies aren't counted as links. Rows
that `vectors.clean` leaves out, and vectors of length zero, are in no class. An empty table gives an empty one.
Columns other than the two that are named aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors
from .components import components, local_roots

COSINE = 0.9
SHARD = 32_768
M, BUILD_BEAM = 16, 64
AUDIT, AUDIT_LEAST, RECALL = 64, 64, 0.97
FIRST_BEAM = 16
BATCH = 1024
#: Vectors that a task asks with at a time, and in all.
BLOCK, TASK_VECTORS = 8192, 65_536
SEED = 7


def _sims(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.matmul(x[ids], q[:, :, None])[:, :, 0]


_kept: list[np.ndarray] = [np.zeros(0, bool), np.zeros(0, np.int16)]


def _flags(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of n, one of them False throughout; their memory is used again."""
    if len(_kept[0]) < n:
        _kept[:] = np.zeros(n, bool), np.zeros(n, np.int16)
    seen, last = (a[:n] for a in _kept)
    seen.fill(False)
    return seen, last


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The best `width` rows of x that each query reaches from its entries (-1: none), and their cosines, best first.

    All queries take their steps together; a step opens the at_once best of a beam that aren't open yet.
    """
    n, wide = len(q), len(x) + 1
    seen, last = _flags(n * wide)
    seen[wide - 1 :: wide] = True
    rows = np.arange(n)[:, None]
    ids = np.full((n, width), -1)
    sims = np.full((n, width), -np.inf, np.float32)
    is_open = np.ones((n, width), bool)

    def add(at: np.ndarray, found: np.ndarray) -> None:
        """Put the unseen of found into the beams of rows `at`."""
        place = (at[:, None] * wide + np.where(found < 0, wide - 1, found)).ravel()
        fresh = np.flatnonzero(~seen[place])
        place = place[fresh]
        # The same one twice in a row of found: only one of them counts.
        column = (fresh % found.shape[1]).astype(np.int16)
        last[place] = column
        one = last[place] == column
        fresh, place = fresh[one], place[one]
        if not len(fresh):
            return
        seen[place] = True
        row = fresh // found.shape[1]
        count = np.bincount(row, minlength=len(at))
        new = place - at[row] * wide
        column = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        more_ids, more_sims = np.full((len(at), count.max()), -1), np.full((len(at), count.max()), -np.inf, np.float32)
        more_ids[row, column] = new
        more_sims[row, column] = np.einsum("ij,ij->i", x[new], q[at[row]])
        all_ids, all_sims = np.concatenate([ids[at], more_ids], 1), np.concatenate([sims[at], more_sims], 1)
        all_open = np.concatenate([is_open[at], more_ids < 0], 1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[at], sims[at], is_open[at] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_open))

    add(np.arange(n), entry)
    active = np.arange(n)
    step = min(at_once, width)
    while True:
        waiting = np.where(is_open[active], -np.inf, sims[active])
        active = active[waiting.max(1) > -np.inf]
        if not len(active):
            break
        waiting = np.where(is_open[active], -np.inf, sims[active])
        best = np.argpartition(-waiting, step - 1, axis=1)[:, :step] if step < width else np.argsort(-waiting, axis=1)[:, :step]
        good = np.take_along_axis(waiting, best, 1) > -np.inf
        chosen = np.where(good, np.take_along_axis(ids[active], best, 1), -1)
        flags = is_open[active]
        np.put_along_axis(flags, best, True, 1)
        is_open[active] = flags
        near = np.where(chosen[:, :, None] < 0, -1, links[chosen])
        add(active, near.reshape(len(active), -1))
    order = np.argsort(-sims, axis=1, kind="stable")
    return ids[rows, order], sims[rows, order]


def choose(x: np.ndarray, q: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none) up to `most`: the nearest to q not nearer to one chosen before; then the nearest."""
    sims = np.where(ids < 0, -np.inf, _sims(x, ids, q))
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    n, c = ids.shape
    own = x[ids]
    between = np.matmul(own, own.transpose(0, 2, 1))
    taken, worst, count = np.zeros((n, c), bool), np.full((n, c), -np.inf, np.float32), np.zeros(n, int)
    for j in range(c):
        take = (ids[:, j] >= 0) & (sims[:, j] > worst[:, j]) & (count < most)
        taken[:, j] = take
        count += take
        worst[take] = np.maximum(worst[take], between[take, j])
    rank = np.argsort(np.where(taken, 0, 1) + np.where(ids < 0, 2, 0), axis=1, kind="stable")[:, :most]
    out = np.full((n, most), -1)
    out[:, : rank.shape[1]] = np.take_along_axis(ids, rank, 1)
    return out


def _layer(x: np.ndarray, entries, degree: int) -> np.ndarray:
    """The links of one layer: rows are put in in batches that double, each searching what is there."""
    n = len(x)
    links = np.full((n, degree), -1)
    done = 0
    while done < n:
        batch = np.arange(done, min(n, done + max(32, min(done, BATCH))))
        q = x[batch]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        some = min(len(batch) - 1, degree)
        found = batch[np.argsort(-among, axis=1, kind="stable")[:, :some]] if some else np.zeros((len(batch), 0), int)
        if done:
            start = entries(batch)
            start = np.where(start < done, start, 0)
            found = np.concatenate([beam_search(x[:done], np.where(links[:done] < done, links[:done], -1), q, start, min(BUILD_BEAM, done))[0], found], 1)
        if not found.shape[1]:
            done += len(batch)
            continue
        new = choose(x, q, found, max(degree // 2, 1))
        links[batch, : new.shape[1]] = new
        # Links go both ways; whoever gets too many chooses again.
        to, whom = new.ravel(), np.repeat(batch, new.shape[1])
        good = to >= 0
        to, whom = to[good], whom[good]
        order = np.lexsort((-(x[to] * x[whom]).sum(1), to))
        to, whom = to[order], whom[order]
        head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        place = np.arange(len(to)) - np.repeat(head, np.diff(np.append(head, len(to))))
        fits = place < degree
        asked = to[head]
        more = np.full((len(asked), degree), -1)
        more[np.repeat(np.arange(len(head)), np.diff(np.append(head, len(to))))[fits], place[fits]] = whom[fits]
        more[(more[:, :, None] == links[asked][:, None, :]).any(2)] = -1
        for i in range(0, len(asked), 512):
            part = asked[i : i + 512]
            links[part] = choose(x, x[part], np.concatenate([links[part], more[i : i + 512]], 1), degree)
        done += len(batch)
    return links


class Graph:
    """A shard's layers: nodes of each (rows of x), and their links (places in the layer's nodes)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.beam = ids, x, FIRST_BEAM
        self.nodes: list[np.ndarray] = [np.arange(len(x))]
        self.links: list[np.ndarray] = []
        rng = np.random.default_rng(SEED)
        while len(self.nodes[-1]) > 2 * M:
            self.nodes.append(np.sort(rng.permutation(self.nodes[-1])[: len(self.nodes[-1]) // M]))
        layers = len(self.nodes)
        self.links = [np.zeros((0, 0), int)] * layers
        for level in range(layers - 1, -1, -1):
            own = x[self.nodes[level]]
            self.links[level] = _layer(own, lambda at, own=own, level=level: self._entries(own[at], level), 2 * M if level == 0 else M)

    def _entries(self, q: np.ndarray, level: int) -> np.ndarray:
        """Where a search of a layer begins: what searches of the layers above lead to."""
        at = np.zeros((len(q), 1), int)
        for up in range(len(self.nodes) - 1, level, -1):
            found, _ = beam_search(self.x[self.nodes[up]], self.links[up], q, at, min(4, len(self.nodes[up])))
            at = np.where(found < 0, -1, np.searchsorted(self.nodes[up - 1], self.nodes[up][found]))
        return at

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(self.x, self.links[0], q, self._entries(q, 0), min(beam, len(self.x)))

    def audit(self, cosine: float) -> None:
        """Widen the beam until probes at the threshold's angle find what brute force finds; 0 means brute force."""
        rng = np.random.default_rng(SEED + 1)
        n = len(self.x)
        at = np.sort(rng.permutation(n)[: max(AUDIT_LEAST, n // AUDIT)])
        side = rng.standard_normal((len(at), self.x.shape[1]))
        side -= (side * self.x[at]).sum(1, keepdims=True) * self.x[at]
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        angle = min(cosine + 1e-4, 1.0)
        probes = (angle * self.x[at] + np.sqrt(1 - angle * angle) * side).astype(np.float32)
        truth = probes @ self.x.T >= cosine
        while self.beam:
            ids, sims = self.search(probes, self.beam)
            hit = (ids >= 0) & (sims >= cosine)
            # A full beam is done again by brute force, so nothing of it is missed, and it says nothing of the others.
            rest = ~hit.all(1) & truth.any(1)
            found, all_ = hit[rest].sum(1), truth[rest].sum(1)
            # Each probe's own recall counts as much as another's, so that large groups don't hide small ones.
            if not rest.any() or (found.sum() >= RECALL * all_.sum() and (found / all_).mean() >= RECALL):
                return
            self.beam = 0 if self.beam >= n else self.beam * 3 // 2

    def near(self, q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of q, row of x) of at least this cosine."""
        if self.beam:
            ids, sims = self.search(q, self.beam)
            hit = (ids >= 0) & (sims >= cosine)
            full = np.flatnonzero(hit.all(1))
            hit[full] = False
            row, place = np.nonzero(hit)
            left, right = [row], [ids[row, place]]
        else:
            full, left, right = np.arange(len(q)), [], []
        for i in range(0, len(full), 256):
            row, place = np.nonzero(q[full[i : i + 256]] @ self.x.T >= cosine)
            left.append(full[i : i + 256][row])
            right.append(place)
        none = np.zeros(0, int)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def pack(self) -> bytes:
        arrays = {f"nodes{i}": a.astype(np.int32) for i, a in enumerate(self.nodes)} | {f"links{i}": a.astype(np.int32) for i, a in enumerate(self.links)}
        return vectors.pack(ids=self.ids, x=self.x, beam=np.array(self.beam), layers=np.array(len(self.nodes)), **arrays)

    @classmethod
    def unpack(cls, a: dict[str, np.ndarray]) -> Graph:
        g = cls.__new__(cls)
        g.ids, g.x, g.beam = a["ids"], a["x"], int(a["beam"])
        g.nodes, g.links = ([a[f"{k}{i}"].astype(np.int64) for i in range(int(a["layers"]))] for k in ("nodes", "links"))
        return g


def normalised(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def classes(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """(id, class_id, links) of every vector."""
    spark = rows.sparkSession
    scratch = common.Scratch(spark, "hnsw")
    held = vectors.clean(rows, ident, vector)
    held = scratch.write(held.where(F.exists("v", lambda x: x != 0)), "vectors")
    firsts = scratch.write(held.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "firsts")
    count = firsts.count()

    def build(ids: np.ndarray, x: np.ndarray) -> bytes:
        g = Graph(ids, normalised(x))
        g.audit(cosine)
        return g.pack()

    path = vectors.build_shards(firsts, vectors.shards_of(count, shard), build, scratch, "shards")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in vectors.blocks(batches, BLOCK):
            x, links = normalised(x), np.zeros(len(ids), np.int64)
            for a in vectors.read_shards(path):
                g = Graph.unpack(a)
                for i in range(0, len(ids), BATCH):
                    q, own = x[i : i + BATCH], ids[i : i + BATCH]
                    row, place = g.near(q, cosine)
                    verified = (q[row].astype(float) * g.x[place].astype(float)).sum(1) >= cosine
                    row, place = row[verified], place[verified]
                    other = own[row] != g.ids[place]
                    row, place = row[other], place[other]
                    links[i : i + BATCH] += np.bincount(row, minlength=len(own))
                    if len(row):
                        # A batch's links as stars, so that groups of thousands don't give millions.
                        nodes, roots = local_roots(own[row], g.ids[place])
                        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.nulls(len(nodes), pa.int64())], names=["a", "b", "links"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(links)], names=["a", "b", "links"])

    tasks = max(common.partitions(spark), -(-count // TASK_VECTORS))
    found = scratch.write(firsts.repartition(tasks, "id").mapInArrow(link, "a long, b long, links long"), "links")
    scratch.drop("shards")
    roots = scratch.write(components(found.where("b is not null").select("a", "b"), scratch), "roots")
    counts = found.where("links is not null").select(F.col("a").alias("first"), "links")
    members = held.join(firsts.withColumnRenamed("id", "first"), "v").select("id", "first").join(counts, "first")
    out = members.join(roots, members["first"] == roots["node"], "left")
    return out.select("id", F.coalesce("root", "first").alias("class_id"), "links")


def near_duplicates(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """(id, duplicate_of): each vector that another one stands for, the least id of its class."""
    return classes(rows, ident, vector, cosine, shard).where("id <> class_id").select("id", F.col("class_id").alias("duplicate_of"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every embedding with its class and its number of links."""
    return classes(common.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: Classes and links by all pairs; what the graphs find is the same where the audits leave nothing out.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_sum([x * x for x in embedding]) > 0),
distinct_v AS (SELECT min(vec_id) AS id, embedding FROM v GROUP BY embedding),
near AS (
  SELECT a.id AS x, b.id AS y FROM distinct_v a JOIN distinct_v b ON a.id <> b.id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {COSINE}),
reached AS (SELECT id AS x, id AS y FROM distinct_v UNION SELECT r.x, n.y FROM reached r JOIN near n ON r.y = n.x),
roots AS (SELECT x AS id, min(y) AS class_id FROM reached GROUP BY 1),
counts AS (SELECT x AS id, count(*) AS links FROM near GROUP BY 1)
SELECT v.vec_id, r.class_id, coalesce(c.links, 0) AS links
FROM v JOIN distinct_v d USING (embedding) JOIN roots r ON r.id = d.id LEFT JOIN counts c ON c.id = d.id
"""
