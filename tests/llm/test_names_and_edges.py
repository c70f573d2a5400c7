"""Extra columns with the operators' own names, and other cases of all operators on documents."""

import random
from collections import Counter

import numpy as np
import pytest

from sahifa.llm import mixing, quality, simhash, suffix

#: Names that the operators use or have used for columns of their own.
NAMES = ["quality", "__quality", "lines", "__lines", "bad", "_bad", "copies", "__copies", "epochs", "__epochs", "ident", "copy", "__epoch", "__source", "cut_key", "__cut_key", "__cut_id", "gone", "__gone", "row", "__row", "starts", "__starts", "ends", "__ends", "key", "id", "first", "root"]


@pytest.fixture(scope="module")
def crowded(spark):
    rng = random.Random(5)
    shared = " ".join(f"w{rng.randrange(300)}" for _ in range(80))
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(10)] + [shared + " one", "two " + shared, shared, shared, None, ""]
    rows = [(i, t, f"s{i % 3}", *range(i, i + len(NAMES))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in NAMES)), rows


@pytest.mark.parametrize(
    "name,run",
    [
        ("quality", lambda spark, d: quality.accept(d, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))),
        ("simhash", lambda spark, d: simhash.dedup(d)),
        ("simhash joined", lambda spark, d: simhash.dedup(d, sent_keys=0)),
        ("suffix", lambda spark, d: suffix.dedup(d)),
        ("mixing", lambda spark, d: mixing.mix(d, {"s0": 1.0, "s1": 2.0}, others=1.0)),
        ("mixing joined", lambda spark, d: mixing.mix(d, {"s0": 1.0, "s1": 2.0}, others=1.0, sent_sources=0)),
    ],
)
def test_columns_of_the_operators_own_names_stay(spark, crowded, name, run):
    docs, rows = crowded
    found = run(spark, docs)
    assert found.columns == docs.columns
    held = {r[0]: tuple(r[3:]) for r in rows}
    got = found.collect()
    assert got and all(tuple(r[3:]) == held[r.doc_id] for r in got)


def test_a_column_named_as_the_epochs_is_replaced(spark, crowded):
    docs, _ = crowded
    found = mixing.mix(docs, {"s0": 5.0}, others=1.0, epoch="copies")
    assert sorted(found.columns) == sorted(docs.columns)
    assert max(r.copies for r in found.collect()) > 1


def test_repeated_anchors_over_many_batches(spark):
    """What repeats is found wherever Arrow batches end."""
    rng = random.Random(8)
    shared = [" ".join(f"w{rng.randrange(300)}" for _ in range(70)) for _ in range(4)]
    rows = [(i, " ".join([*(f"w{rng.randrange(300)}" for _ in range(30)), rng.choice(shared)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, suffix.repeated_passages(docs).select("doc_id", "start", "end", "kept_in").collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(tuple, suffix.repeated_passages(docs).select("doc_id", "start", "end", "kept_in").collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) >= 50


@pytest.mark.parametrize("seed", range(3))
def test_large_buckets_lose_no_link(seed):
    """Of a bucket with clusters, chains and rows alone, the links connect what all pairs connect."""
    from sahifa.llm.components import local_roots

    rng = np.random.default_rng(seed)

    def flipped(x, n):
        bits = np.zeros(128, np.uint8)
        bits[rng.choice(128, n, replace=False)] = 1
        return x ^ np.packbits(bits).view(np.uint64)

    rows = [rng.integers(0, 256, 16, dtype=np.uint8).view(np.uint64) for _ in range(400)]
    rows += [flipped(rows[0], int(rng.integers(1, 12))) for _ in range(300)]
    for _ in range(150):
        rows.append(flipped(rows[-1], 15))
    for i in range(1, 60):
        rows += [flipped(rows[i], 5) for _ in range(3)]
    p = np.stack(rows)[rng.permutation(len(rows))]
    key = np.where(np.arange(len(p)) % 10 == 0, 1, 7).astype(np.int32)
    a, b = simhash.bucket_links(key, p[:, 0], p[:, 1], simhash.MOST_BITS)
    far = sum(np.bitwise_count(p[:, None, i] ^ p[None, :, i]).astype(int) for i in range(2))
    assert (far[a, b] <= simhash.MOST_BITS).all() and (key[a] == key[b]).all()
    x, y = np.nonzero(np.triu((far <= simhash.MOST_BITS) & (key[:, None] == key[None, :]), 1))
    assert dict(zip(*(v.tolist() for v in local_roots(a, b)))) == dict(zip(*(v.tolist() for v in local_roots(x, y))))


def test_mixing_cuts_and_repeats(spark):
    rows = [(i, "a" if i < 90 else "b", "one two three") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = Counter(r.source for r in mixing.mix(docs, {"a": 1.0, "b": 1.0}).collect())
    assert found == {"a": 50, "b": 50}
    assert mixing.mix(docs, {"c": 1.0}).count() == 0
