"""The registered query of operator 4 against brute force, on a table with near copies, copies and awkward rows."""

import numpy as np
import pytest

from sahifa.llm import hnsw
from sahifa.llm.components import local_roots

SF = "/root/testdata/sf0.001"


def brute(x):
    """Class and links of each row of x."""
    unit = hnsw.normalised(x.astype(np.float32)).astype(float)
    near = unit @ unit.T >= hnsw.COSINE
    same = (x.astype(np.float32)[:, None] == x.astype(np.float32)[None]).all(2)
    a, b = np.nonzero(near | same)
    nodes, roots = local_roots(a, b)
    _, first = np.unique(x.astype(np.float32), axis=0, return_index=True)
    links = near[:, first].sum(1) - 1
    return dict(zip(nodes.tolist(), roots.tolist())), dict(enumerate(links.tolist()))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    base = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()])
    near = np.concatenate([base[i] + rng.normal(size=(n, base.shape[1])) * 0.03 * np.linalg.norm(base[i]) / 4 for i, n in zip(range(12), [1, 1, 2, 3, 5, 8, 1, 1, 40, 1, 2, 1])])
    x = np.concatenate([base, near, base[:7]])
    path = tmp_path_factory.mktemp("embeddings")
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)] + [(None, [1.0], 1), (9000, None, 1), (9001, [], 1), (9002, [0.0] * x.shape[1], 1), (9003, [1.0, 2.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, class_id int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path), x


def test_query_against_brute_force(spark, planted):
    path, x = planted
    rows = hnsw.query(spark, path).collect()
    classes, links = brute(x)
    assert sorted(r.vec_id for r in rows) == list(range(len(x)))
    found = {r.vec_id: r.class_id for r in rows}
    assert sum(found[i] != classes[i] for i in found) <= 0.02 * len(x)
    missed = sum(abs(r.links - links[r.vec_id]) for r in rows)
    assert missed <= 0.03 * sum(links.values()) and max(links.values()) >= 40
    assert len({c for i, c in found.items() if c != i}) >= 12


def test_query_on_the_table(spark):
    rows = hnsw.query(spark, SF).collect()
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()])
    classes, links = brute(x)
    assert {r.vec_id: (r.class_id, r.links) for r in rows} == {i: (classes[i], links[i]) for i in classes}


def test_blocks_and_shards_do_not_matter(spark, planted, monkeypatch):
    path, x = planted
    table = spark.read.parquet(f"{path}/embeddings.parquet")
    monkeypatch.setattr(hnsw, "BLOCK", 7)
    found = {r.id: r.class_id for r in hnsw.classes(table, shard=50).collect()}
    classes, _ = brute(x)
    assert sum(found[i] != classes[i] for i in found) <= 0.02 * len(x)
