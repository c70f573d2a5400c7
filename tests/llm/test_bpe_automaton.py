"""The automaton's tables against BPE by its definition, and the registered query against it on whole documents."""

import random
from collections import Counter

import numpy as np
import pytest
import regex

from sahifa.llm import bpe

SF = "/root/testdata/sf0.001"


def small_ranks(rng, merges=60):
    """A vocabulary of few letters, made by merging what is adjacent most often."""
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(3, 12))) for _ in range(300)]
    ranks = {bytes([b]): b for b in range(256)}
    for _ in range(merges):
        parts = [bpe.plain_bpe(w, ranks) for w in words]
        pairs = Counter(p for w in parts for p in zip(w, w[1:]))
        (a, b), _ = pairs.most_common(1)[0]
        ranks[a + b] = len(ranks)
    return ranks


@pytest.mark.parametrize("seed", range(4))
def test_small_vocabularies(seed):
    rng = random.Random(seed)
    ranks = small_ranks(rng)
    automaton = bpe.Automaton(ranks, arc_slots=1 << 6)
    words = [bytes(rng.choice(b"abcde") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    ids, size = automaton.encode_many(words)
    want = [[ranks[p] for p in bpe.plain_bpe(w, ranks)] for w in words]
    assert size.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_every_pair_of_a_small_vocabulary():
    ranks = {k: v for k, v in small_ranks(random.Random(9), 25).items() if set(k) <= set(b"abcd")}
    automaton = bpe.Automaton(ranks)
    tokens = list(ranks)
    for a in tokens:
        for b in tokens:
            arc = automaton.arcs(np.array([ranks[a]]), np.array([ranks[b]]))[0]
            assert arc == (bpe.plain_bpe(a + b, ranks) == [a, b])


def test_long_words_and_bytes_of_any_kind(monkeypatch):
    automaton, ranks, rng = bpe.encoder().automaton, bpe.read_ranks(), random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 2, 50, 299, 300, 301, 900)] + [b"a" * 700, b"\n" * 400, b""]
    ids, size = automaton.encode_many(words)
    assert automaton.decode(ids[: size[0]]) == words[0].decode("utf-8", "replace")
    want = [[ranks[p] for p in bpe.plain_bpe(w, ranks)] for w in words]
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want
    monkeypatch.setattr(bpe, "TOGETHER", 10)
    assert automaton.encode_many(words)[0].tolist() == ids.tolist()


def test_tokens_that_merges_do_not_give_are_only_decoded():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3}
    automaton = bpe.Automaton(ranks)
    assert automaton.encode(b"abc") == [0, 1, 2] and automaton.decode([3, 0]) == "abca"
    with pytest.raises(ValueError):
        automaton.encode(b"x")


def test_slots_of_one_another():
    table, rng = bpe.Slots(1 << 10), np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**40, 700))
    table.put(keys[::2], np.arange(len(keys[::2])))
    table.put(keys[1::2], np.arange(len(keys[1::2])))
    assert table.get(keys[::2], -1).tolist() == list(range(len(keys[::2]))) and table.get(keys[1::2], -1).tolist() == list(range(len(keys[1::2])))
    assert (table.get(np.setdiff1d(np.arange(1000), keys), -7) == -7).all()
    table.clear()
    assert (table.get(keys, -1) == -1).all()


def test_kept_words_start_anew(monkeypatch):
    enc = bpe.Encoder(bpe.encoder().automaton)
    texts = ["one two, two\nthree", "it's 12 o'clock. ", " two  spaces", "", None, "naïve ☃ text"]
    ids, ends = enc.encode_all(texts)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    again = enc.encode_all(texts)
    assert again[0].tolist() == ids.tolist() and again[1].tolist() == ends.tolist() and enc.rows_held <= 30


def test_the_query_against_bpe_by_definition(spark):
    ranks, split, known = bpe.read_ranks(), regex.compile(bpe.PATTERN).findall, {}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.query(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = []
        for w in split(texts[r.doc_id]):
            if w not in known:
                known[w] = [ranks[p] for p in bpe.plain_bpe(w.encode(), ranks)]
            want += known[w]
        assert r.tokens == want and r.n_tokens == len(want)
