"""Operators on URLs, pages and vectors against brute force and round trips, and the cases their docstrings name."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sahifa.llm import annkd, common, hnsw, urlfilter, vectors, warc
from sahifa.llm.components import components, local_roots

SF = "/root/testdata/sf0.001"

# URL filter (1)


def test_cascade_is_exact_on_its_universe():
    rng = np.random.default_rng(0)
    h0, h1 = (rng.integers(0, 2**63, 50_000).astype(np.uint64) for _ in range(2))
    for share in (0.0, 0.001, 0.3, 0.9, 1.0):
        listed = rng.random(50_000) < share
        levels = urlfilter.build_cascade(h0, h1, listed)
        assert (urlfilter.ask_cascade(levels, h0, h1) == listed).all()
    assert len(urlfilter.build_cascade(h0, h1, rng.random(50_000) < 0.3)) > 2


def test_cascade_refuses_keys_that_hash_alike():
    same = np.zeros(2, np.uint64)
    with pytest.raises(ValueError):
        urlfilter.build_cascade(same, same, np.array([True, False]))


@pytest.mark.parametrize("shard_keys,sent_bytes", [(10**6, 10**6), (40, 10**6), (40, 0)])
def test_url_filter_against_a_set(spark, shard_keys, sent_bytes):
    rng = random.Random(7)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.'])}h{rng.randrange(20)}.org/p{rng.randrange(30)}{rng.choice(['', '/', '?q=1', '#x'])}" for _ in range(600)]
    listed = [f"https://h{rng.randrange(25)}.org/p{rng.randrange(30)}" for _ in range(200)] + [None]
    rows = [(i, u, 1, "c") for i, u in enumerate(urls)] + [(900, None, 1, "c"), (901, "", 1, None), (902, "", 2, None)]

    def key(u):
        u = u.split("://", 1)[-1]
        return u.removeprefix("www.").split("?")[0].split("#")[0].rstrip("/")

    bad = {key(u) for u in listed if u is not None}
    pages = spark.createDataFrame([(*r[:2], r[2], r[2], r[3]) for r in rows], "page_id long, url string, shard int, part int, h0 string")
    found = urlfilter.filter_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string"), shard_keys=shard_keys, sent_bytes=sent_bytes)
    assert found.columns == pages.columns
    assert sorted(r.page_id for r in found.collect()) == [i for i, u, *_ in rows if u is None or key(u) not in bad]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_url_filter_of_nothing(spark):
    pages = spark.createDataFrame([(1, "a.org")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    assert urlfilter.filter_urls(pages, none).count() == 1
    assert urlfilter.filter_urls(pages, none, sent_bytes=-1).count() == 1
    assert urlfilter.filter_urls(pages.where("false"), pages).count() == 0


# WARC (8)

PAGES = [(i, f"http://x.org/{i}", f"<p>{i} " + "é" * (i * 40)) for i in range(50)] + [(None, None, None), (7, "u\r\nX: y", ""), (8, "", None), (8, "", None), (60, "big", "z" * 300_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, "extra", 1) for r in PAGES], "page_id long, url string, html string, data string, bundle int")
    frames = common.Scratch(spark, "t").write(warc.bundle_frames(pages, frame_bytes=4000), "f")
    back = [tuple(r) for r in warc.read_frames(frames).collect()]
    want = [(i, u if u is None else u.replace("\r", "%0D").replace("\n", "%0A"), h) for i, u, h in PAGES]
    assert sorted(map(str, back)) == sorted(map(str, want))


def test_warc_seek_and_ordinary_tools(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(2)
    frames = common.Scratch(spark, "t").write(warc.bundle_frames(pages, frame_bytes=4000), "f")
    warc.write_bundles(frames, tmp_path.as_uri())
    index = warc.index(frames).collect()
    assert len(index) == len(PAGES)
    for r in index:
        with open(tmp_path / f"bundle-{r.bundle:06d}.warc.zst", "rb") as f:
            headers, _ = warc.read_record(f, r.frame, r.offset, r.length)
        assert headers["WARC-Record-ID"] == f"<{r.record_id}>" and headers.get("X-Page-ID") == (None if r.page_id is None else str(r.page_id))
    for file in tmp_path.glob("*.zst"):
        with open(file, "rb") as f:
            plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        at = 0
        while at < len(plain):
            *_, at = warc.parse_record(plain, at)
        assert at == len(plain)


def test_warc_of_nothing(spark):
    assert warc.bundle_frames(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Vectors (4, 7)

AWKWARD = [(None, [1.0, 0.0]), (900, None), (901, []), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0]), (905, [0.0] * 8), (906, [float("inf")] * 8)]


def table(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_vectors_clean(spark):
    x = np.random.default_rng(0).normal(size=(20, 8))
    rows = vectors.clean(table(spark, x, [*AWKWARD, (3, [-9.0] * 8)]), "vec_id", "embedding").collect()
    assert sorted(r.id for r in rows) == [*range(20), 905]
    assert next(r.v for r in rows if r.id == 3) == min([float(np.float32(v)) for v in x[3]], [-9.0] * 8)


def test_chi_square():
    draws = (np.random.default_rng(1).normal(size=(200_000, 8)) ** 2).sum(1)
    for x in (2.0, 7.0, 13.4):
        assert abs(annkd.chi_square(np.array(x), 8) - (draws <= x).mean()) < 0.005


@pytest.mark.parametrize("shard", [10_000, 300])
def test_nearest_against_brute_force(spark, shard):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 1000)] * 4 + rng.normal(size=(1000, 16))
    x[10] = x[11]
    rows = annkd.nearest(table(spark, x, AWKWARD), shard=shard).collect()
    d = ((x.astype(np.float32)[:, None] - x.astype(np.float32)[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, 1)[:, : annkd.K]
    got = {}
    for r in rows:
        got.setdefault(r.id, {})[r.rank] = (r.neighbour, r.distance)
    assert set(got) == set(range(1000)) and all(sorted(g) == list(range(1, annkd.K + 1)) for g in got.values())
    recall = np.mean([len({n for n, _ in got[i].values()} & set(true[i])) / annkd.K for i in range(1000)])
    assert recall >= 0.9
    assert got[10][1][0] == 11 and all(abs(v - np.sqrt(d[i, n])) < 1e-2 for i in range(0, 1000, 50) for n, v in got[i].values())


def test_nearest_on_the_table(spark):
    rows = annkd.query(spark, SF).collect()
    t = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in t]), np.array([r.vec_id for r in t])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    true = {(ids[i], ids[j]) for i, row in enumerate(np.argsort(d, 1)[:, : annkd.K]) for j in row if ids[i] % annkd.EVERY == 0}
    assert {r.vec_id for r in rows} == {i for i in ids if i % annkd.EVERY == 0} and len(rows) * annkd.EVERY == annkd.K * len(ids)
    assert len(true & {(r.vec_id, r.neighbour) for r in rows}) >= 0.9 * len(true)


def test_nearest_of_few(spark):
    assert annkd.nearest(table(spark, np.eye(3))).count() == 6
    assert annkd.nearest(table(spark, [])).count() == 0


def near_sets(rng):
    x = rng.normal(size=(600, 24))
    copies = np.concatenate([x[i] + rng.normal(size=(int(n), 24)) * 0.05 for i, n in zip(range(30), [1] * 28 + [150, 300])])
    return np.concatenate([x, copies, x[:20]])


@pytest.mark.parametrize("shard", [10_000, 200])
def test_hnsw_components_against_brute_force(spark, shard):
    x = near_sets(np.random.default_rng(3))
    unit = hnsw.normalised(x.astype(np.float32))
    a, b = np.nonzero(np.triu(unit @ unit.T >= hnsw.COSINE, 1))
    nodes, roots = local_roots(a, b)
    want = {(int(n), int(r)) for n, r in zip(nodes, roots) if n != r}
    got = {(r.id, r.duplicate_of) for r in hnsw.near_duplicates(table(spark, x, AWKWARD), shard=shard).collect()}
    assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_hnsw_audit_widens_the_beam():
    rng = np.random.default_rng(4)
    x = hnsw.normalised(rng.normal(size=(500, 32)).astype(np.float32))
    x = np.concatenate([x, hnsw.normalised(x[:100] + 0.04 * rng.normal(size=(100, 32)).astype(np.float32))])
    g = hnsw.Graph(np.arange(len(x)), x)
    g.links[0][:, 3:] = -1
    g.beam = 2
    g.audit(0.9)
    assert g.beam == 0 or g.beam > 2
    row, place = g.near(x, 0.9)
    truth = x @ x.T >= 0.9
    assert truth[row, place].all() and len(row) >= 0.9 * truth.sum()
    g.links[0][:] = -1
    g.audit(0.9)
    assert g.beam == 0 and len(g.near(x, 0.9)[0]) == truth.sum()


def test_hnsw_of_few(spark):
    assert hnsw.near_duplicates(table(spark, [])).count() == 0
    assert hnsw.near_duplicates(table(spark, np.ones((3, 4)))).count() == 2


# Components


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (None, 3)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = components(spark.createDataFrame(pairs, "a long, b long"), common.Scratch(spark, "t"), one_task)
    assert {r.node: r.root for r in found.collect()} == {a: find(a) for a, b in pairs for a in (a, b) if a is not None and a in parent and any(x != y and a in (x, y) for x, y in pairs if x is not None)}
    none = spark.createDataFrame([], "a long, b long")
    assert components(none, common.Scratch(spark, "t"), one_task).count() == 0


def test_shared_folder_is_asked_of_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert F.lit(1) is not None
