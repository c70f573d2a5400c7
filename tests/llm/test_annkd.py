"""The kd-tree over stable projections: cells, how much is verified, copies, ties and columns."""

import io

import numpy as np
import pytest

from sahifa.llm import annkd


def clusters(rng, n, length=64):
    return (rng.normal(size=(400, length)) * 8)[rng.integers(0, 400, n)] + rng.normal(size=(n, length))


def distances(x, at):
    x = x.astype(np.float32)
    d = ((x[at][:, None] - x[None]) ** 2).sum(2)
    d[np.arange(len(at)), at] = np.inf
    return d


def table(spark, x, names="vec_id long, embedding array<float>", more=()):
    return spark.createDataFrame([(i, [float(v) for v in row], *more) for i, row in enumerate(x)], names)


def test_few_vectors_of_clusters_are_verified():
    x = clusters(np.random.default_rng(0), 16384).astype(np.float32)
    shard = dict(np.load(io.BytesIO(annkd.build(np.arange(len(x)), x)[0])))
    at = np.arange(0, len(x), 100)
    found = annkd.Nearest(at, x[at])
    found.ask(shard)
    assert found.verified < 0.2 * len(at) * len(x)
    true = np.argsort(distances(x, at), 1)[:, : annkd.K]
    assert np.mean([len(set(a) & set(b)) / annkd.K for a, b in zip(found.ids, true)]) >= 0.9


def test_the_tree_holds_every_row_once():
    p = np.random.default_rng(1).normal(size=(1000, 8)).astype(np.float32)
    p[:400] = p[0]
    order, tree = annkd.kd_tree(p, 16)
    assert sorted(order) == list(range(1000))
    leaf = tree["left"] < 0
    places = np.concatenate([np.arange(a, b) for a, b in zip(tree["begin"][leaf], tree["end"][leaf])])
    assert sorted(places) == list(range(1000)) and (tree["end"] - tree["begin"])[leaf].max() <= 16
    for n in range(len(leaf)):
        own = p[order[tree["begin"][n] : tree["end"][n]]]
        assert (annkd.box_distance(own, tree["low"][n], tree["high"][n]) == 0).all()


def test_cells_of_the_top():
    p = np.random.default_rng(2).normal(size=(4000, 8)).astype(np.float32)
    top = annkd.Top(p, 8)
    assert top.depth == 3 and np.bincount(top.cell(p), minlength=8).min() > 300
    assert annkd.Top(p[:0], 8).depth == 0 and annkd.Top(np.ones((100, 8), np.float32), 8).cell(p[:5]).max() < 8


@pytest.mark.parametrize("every", [1, 7])
def test_cells_and_copies_against_brute_force(spark, every):
    rng = np.random.default_rng(3)
    x = clusters(rng, 1500, 16)
    x[rng.permutation(1500)[:500]] = x[0]
    rows = annkd.nearest(table(spark, x), shard=128, every=every).collect()
    at = np.arange(0, 1500, every)
    d = distances(x, at)
    got = {}
    for r in rows:
        got.setdefault(r.id, {})[r.rank] = r
    assert sorted(got) == at.tolist() and all(sorted(g) == list(range(1, annkd.K + 1)) for g in got.values())
    kth = np.sort(d, 1)[:, : annkd.K]
    # Of copies at one distance some are true neighbours; so distances are compared.
    near = [np.mean([r.distance**2 <= k[-1] + 1e-3 for r in got[i].values()]) for i, k in zip(at.tolist(), kth)]
    assert np.mean(near) >= 0.9
    assert all(got[i][j].neighbour != i for i in got for j in got[i])


def test_ties_go_by_id(spark):
    x = np.zeros((300, 4))
    x[:, 0] = 1
    rows = annkd.nearest(table(spark, x), every=20).collect()
    assert {r.id: [] for r in rows}.keys() == set(range(0, 300, 20))
    for i in range(0, 300, 20):
        assert sorted((r.rank, r.neighbour) for r in rows if r.id == i) == list(enumerate([j for j in range(300) if j != i][: annkd.K], 1))


def test_columns_of_clashing_names(spark):
    rows = table(spark, np.eye(6), "vec_id long, embedding array<float>, id int, v int, cell int, shard int, low int", (1, 2, 3, 4, 5))
    assert annkd.nearest(rows).columns == ["id", "rank", "neighbour", "distance"] and annkd.nearest(rows).count() == 30
