"""Connected components of a table of pairs: every node with the least node that it is connected to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: So many pairs fit one task's memory; above it the rounds below do the same work spread over the cluster.
ONE_TASK = 2_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of pairs (a[i], b[i]) in order, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (root[x], root[y], x, y):
            np.minimum.at(new, side, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def components(pairs: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of pairs(a, b), both long; root is the least node of the component.

    Pairs with a null or of a node with itself say nothing and are left out. No pairs give an empty table.
    """
    schema = "node long, root long"
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    pairs = scratch.write(pairs, "pairs")
    if pairs.count() <= one_task:

        def run(batches):
            parts = list(batches)
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            nodes, roots = local_roots(t.column("a").to_numpy(), t.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

        return pairs.coalesce(1).mapInArrow(run, schema)
    stars, turn = pairs, 0
    while True:
        # Large star: every larger neighbour of a node is tied to the least neighbour instead.
        near = stars.union(stars.select("b", "a"))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = scratch.write(large, f"large{turn}")
        # Small star: a node and its lesser neighbours are tied to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        small = scratch.write(small.where("a > b").distinct(), f"small{turn}")
        scratch.drop(f"large{turn}", *([f"small{turn - 1}"] if turn else ["pairs"]))
        many = small.groupBy("a").count().where("count > 1").limit(1).count() or small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        stars, turn = small, turn + 1
        if not many:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())
