"""The dictionary of operator 3 is made of all that it is trained on, however few parts there are."""

import numpy as np
import pytest

from sahifa.llm import common, tokenbin


def held(data, phrases):
    return sum(p[64:96] in data for p in phrases)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(1)
    phrases = [[rng.bytes(256) for _ in range(40)] for _ in range(8)]
    return phrases, [[b"".join(own[i] for i in rng.integers(0, 40, 4)) for _ in range(300)] for own in phrases]


@pytest.mark.parametrize("parts", [2, 8, 32, 33])
def test_each_of_few_parts_is_in_the_dictionary(spark, groups, parts):
    if parts > 8:
        rng = np.random.default_rng(parts)
        phrases = [[rng.bytes(256) for _ in range(40)] for _ in range(parts)]
        samples = [[b"".join(own[i] for i in rng.integers(0, 40, 4)) for _ in range(100)] for own in phrases]
    else:
        phrases, samples = (x[:parts] for x in groups)
    of = spark.sparkContext.parallelize([[(x,) for x in own] for own in samples], len(samples)).flatMap(lambda x: x)
    data = tokenbin.dictionary(spark.createDataFrame(of, "ids binary"), common.Scratch(spark, "t"))
    assert len(data) <= tokenbin.DICTIONARY_BYTES
    assert min(held(data, own) for own in phrases) >= (5 if parts <= 8 else 1)


def test_each_of_few_long_samples_is_in_the_dictionary(groups):
    phrases, samples = groups
    data = tokenbin.train([b"".join(own) for own in samples], 16 << 10)
    assert len(data) <= 16 << 10 and min(held(data, own) for own in phrases) >= 1


def test_what_cannot_be_trained_on_is_taken_from_all_over(monkeypatch):
    import zstandard

    def fails(*args, **kwargs):
        raise zstandard.ZstdError

    monkeypatch.setattr(zstandard, "train_dictionary", fails)
    samples = [bytes([i]) * 1000 for i in range(20)]
    data = tokenbin.train(samples, 8 << 10)
    assert len(data) <= 8 << 10 and set(data) == set(range(20))
    assert tokenbin.train(samples, 1 << 20) == b"".join(samples)


def test_the_query_against_bpe_by_definition(spark):
    """Every frame, by its place in its shard, holds the ids that BPE by its definition gives."""
    import hashlib

    import regex

    from sahifa.llm import bpe

    ranks, split, known = bpe.read_ranks(), regex.compile(bpe.PATTERN).findall, {}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = tokenbin.query(spark, "/root/testdata/sf0.001").collect()
    data = bytes(next(r.frame for r in rows if r.shard == -1))
    own = [r for r in rows if r.shard >= 0]
    assert sorted(r.doc_id for r in own) == sorted(texts) and {r.dict_hash for r in rows} == {hashlib.sha256(data).hexdigest()}
    shards = {s: b"".join(bytes(r.frame) for r in sorted((r for r in own if r.shard == s), key=lambda r: r.offset)) for s in {r.shard for r in own}}
    for r in own:
        want = []
        for w in split(texts[r.doc_id]):
            if w not in known:
                known[w] = [ranks[p] for p in bpe.plain_bpe(w.encode(), ranks)]
            want += known[w]
        frame = shards[r.shard][r.offset : r.offset + r.length]
        assert tokenbin.decompress(frame, r.dict_hash, data).tolist() == want and r.n_tokens == len(want)


def test_nulls_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "a b", 1, 2), (1, "a b", 3, 4), (None, "c", 5, 6), (2, None, 7, 8), (3, "", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens int")
    found = tokenbin.compress(tokenbin.serialised(docs), b"").collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "3", "None"]
    assert {r.doc_id: (r.n_tokens, r.frame is None) for r in found} == {1: (2, False), None: (1, False), 2: (None, True), 3: (0, False)}
