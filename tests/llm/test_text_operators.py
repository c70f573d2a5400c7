"""Operators on texts against brute force, round trips and held-out accuracy, and the cases their docstrings name."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sahifa.llm import bpe, common, mixing, quality, simhash, suffix, tokenbin

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " ", "\n\n", "a", "ab " * 3000, "x" * 50_000, "é" * 300, "日本語 テキスト\t😀", "don't  stop\n\n now "]


def documents(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# BPE (5)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_bpe_gives_the_ids_of_the_definition(spark, reference):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + AWKWARD
    rows = bpe.bpe_encode(documents(spark, list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = None if texts[r.doc_id] is None else reference.encode_ordinary(texts[r.doc_id])
        assert r.tokens == want and r.n_tokens == (None if want is None else len(want))


def test_bpe_automaton_on_random_bytes():
    ranks = bpe.read_ranks()
    automaton, rng = bpe.Automaton(ranks), random.Random(3)
    for _ in range(2000):
        word = bytes(rng.choice(b"abcdeing \xc3\xa9\xff") for _ in range(rng.randrange(1, 14)))
        assert automaton.encode(word) == [ranks[p] for p in bpe.plain_bpe(word, ranks)]


def test_bpe_decodes_what_it_encoded(spark):
    texts = [t for t in AWKWARD if t is not None]
    rows = bpe.bpe_decode(bpe.bpe_encode(documents(spark, list(enumerate(texts))), keep_text=False)).collect()
    assert {r.doc_id: r.text for r in rows} == dict(enumerate(texts))


def test_bpe_clashing_columns_and_empty_table(spark):
    clash = documents(spark, [(1, "a b", "old", 7)], "doc_id long, text string, TOKENS string, n_tokens int")
    assert bpe.bpe_encode(clash).columns == ["doc_id", "text", "tokens", "n_tokens"]
    assert bpe.bpe_encode(documents(spark, [])).count() == 0


# Token binaries (3)


def test_token_binary_round_trip(spark, reference):
    texts = AWKWARD + [" ".join(words(random.Random(i), 300)) for i in range(40)]
    docs = documents(spark, list(enumerate(texts)))
    scratch = common.Scratch(spark, "t")
    rows = scratch.write(tokenbin.serialised(docs), "ids")
    data = tokenbin.dictionary(rows, scratch, most=2048, part=512, slice_bytes=2000, fan_in=4)
    assert 0 < len(data) <= 2048
    found = tokenbin.compress(rows, data).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = tokenbin.decompress(r.frame, r.dict_hash, data)
        want = texts[r.doc_id]
        assert (None if ids is None else ids.tolist()) == (None if want is None else reference.encode_ordinary(want))
    with pytest.raises(ValueError):
        tokenbin.decompress(found[1].frame, "other", data)


def test_token_binary_offsets_lead_to_frames(spark, tmp_path):
    docs = documents(spark, [(i, f"text number {i} " * i) for i in range(30)])
    scratch = common.Scratch(spark, "t")
    rows = scratch.write(tokenbin.serialised(docs), "ids")
    packed = scratch.write(tokenbin.compress(rows, b""), "packed")
    index = tokenbin.write_shards(packed, tmp_path.as_uri()).collect()
    frames = {r.doc_id: bytes(r.frame) for r in packed.collect()}
    for r in index:
        with open(tmp_path / f"shard-{r.shard:06d}.ids", "rb") as f:
            f.seek(r.offset)
            assert f.read(r.length) == frames[r.doc_id]


def test_token_binary_of_nothing(spark):
    scratch = common.Scratch(spark, "t")
    rows = scratch.write(tokenbin.serialised(documents(spark, [])), "ids")
    assert tokenbin.dictionary(rows, scratch) == b"" and tokenbin.compress(rows, b"").count() == 0


def test_token_binary_query_keeps_its_dictionary(spark):
    rows = tokenbin.query(spark, SF).collect()
    held = [r for r in rows if r.shard == -1]
    assert len(held) == 1 and len(rows) == 201
    one = next(r for r in rows if r.n_tokens)
    assert len(tokenbin.decompress(bytes(one.frame), one.dict_hash, bytes(held[0].frame))) == one.n_tokens


# Quality (6)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    field = quality.train(docs, labels.where(fold == 0))
    test = labels.where(fold == 1).select("doc_id", F.col("quality").alias("good"))
    rows = quality.score(docs.join(test, "doc_id"), field).select("good", "quality").collect()
    right = [(r.quality >= quality.THRESHOLD) == bool(r.good) for r in rows]
    kept = [r.quality >= quality.THRESHOLD for r in rows if r.good]
    assert np.mean(right) > 0.95 and np.mean(kept) > 0.97


def test_quality_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    field = quality.Field(3)
    field.weight, field.bias, field.step = rng.normal(size=3), 0.3, rng.normal(size=(2, 2))
    x, row = rng.normal(size=(7, 3)), np.array([0, 0, 0, 0, 1, 1, 2])
    score, got = x @ field.weight + field.bias, field.marginals(x, row)
    for d in range(3):
        at = np.flatnonzero(row == d)
        total, good = 0.0, np.zeros(len(at))
        for labelling in np.ndindex(*[2] * len(at)):
            y = np.array(labelling)
            weight = np.exp((score[at] * y).sum() + sum(field.step[a, b] for a, b in zip(y[:-1], y[1:])))
            total += weight
            good += weight * y
        assert np.allclose(got[at], good / total)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, t, "old", 5) for i, t in enumerate(AWKWARD)] + [(None, "some good words here.", "x", 1), (1, "Fine words, well put.", "x", 1), (2, "BUY!!! $$$ |||| ###", "x", 1)]
    docs = documents(spark, rows, "doc_id long, text string, Quality string, __good int")
    scored = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(scored) == len(rows) and all(r.quality == 0 for r in scored if not (r.text or "").strip())
    kept = quality.accept(docs, labels)
    assert kept.columns == docs.columns
    assert quality.accept(documents(spark, []), labels).count() == 0
    unlabelled = quality.accept(docs, labels.where("false"))
    assert unlabelled.count() == sum(bool((r[1] or "").strip()) for r in rows)


# SimHash (9)


def test_golay_code_and_keys():
    codewords = [v for v in range(1 << 12) if True]
    encoded = np.array([(v << 11) | int(simhash.syndrome(np.array([v << 11]))[0]) for v in codewords])
    assert (simhash.syndrome(encoded) == 0).all()
    least = min(int(x).bit_count() for x in encoded[1:])
    assert least == 7
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 23, 3000)
    for flips in (1, 2):
        b = a.copy()
        for _ in range(flips):
            b ^= 1 << rng.integers(0, 23, 3000)
        keys = [[{k for k in row if k >= 0} for row in simhash.segment_keys(v)] for v in (a, b)]
        assert all(x & y for x, y in zip(*keys))


def near_copies(rng, n=120, groups=25):
    rows, of = [], {}
    for i in range(n):
        rows.append((i, " ".join(words(rng, 200, 5000))))
        of[i] = i
    for g in range(groups):
        for _ in range(rng.randrange(1, 5)):
            w = rows[g][1].split()
            for _ in range(3):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
            of[len(rows) - 1] = g
    return rows, of


def test_simhash_finds_copies_and_leaves_the_rest(spark):
    rows, of = near_copies(random.Random(5))
    found = {r.doc_id: r.duplicate_of for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    copies = {i for i, g in of.items() if i != g}
    assert len(copies & set(found)) >= 0.9 * len(copies) and set(found) <= copies
    assert all(of[i] == g for i, g in found.items())


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = simhash.fingerprints(docs).collect()
    p = np.array([[r.p0, r.p1] for r in rows]).view(np.uint64)
    ids = np.array([r.id for r in rows])
    far = np.bitwise_count(p[:, None, 0] ^ p[None, :, 0]) + np.bitwise_count(p[:, None, 1] ^ p[None, :, 1])
    a, b = np.nonzero(np.triu(far <= simhash.MOST_BITS, 1))
    nodes, roots = simhash.local_roots(ids[a], ids[b])
    want = {(int(n), int(r)) for n, r in zip(nodes, roots) if n != r}
    got = {(r.doc_id, r.duplicate_of) for r in simhash.near_duplicates(docs).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_simhash_edges(spark):
    rows = [(i, t, 1, "k") for i, t in enumerate(AWKWARD)] + [(None, "same words", 1, "k"), (None, "same words", 2, "k"), (50, "same words", 3, "k"), (50, "same words", 4, "k"), (51, "SAME words!", 5, "k")]
    docs = documents(spark, rows, "doc_id long, text string, root int, first string")
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*range(len(AWKWARD)), None, None, 50, 50])
    assert simhash.dedup(docs, sent_keys=0).count() == kept.count()
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# Suffix sort (2)


def brute_passages(rows, n):
    """For each document the words that are in a passage which was there before, by (doc_id, text, place)."""
    first, gone = {}, {}
    keyed = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    for i, t in keyed:
        w = t.split()
        gone[i, t] = set()
        for p in range(len(w) - n + 1):
            if first.setdefault(tuple(w[p : p + n]), (i, t, p)) != (i, t, p):
                gone[i, t] |= set(range(p, p + n))
    return gone


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"a{x}" for x in rng.integers(0, 3, 30)) for _ in range(40)]
    s = suffix.Stretches(pa.array([t.encode() for t in texts]), np.zeros(40, int), np.zeros(40, int), np.full(40, 20), 5)
    order = s.sort()
    lists = [s.hash[s.at[i] : s.end[i]].tolist() for i in order]
    keys = s.key[order]
    for a, b, x, y in zip(lists[:-1], lists[1:], keys[:-1], keys[1:]):
        assert x < y or (x == y and a <= b)
    of = s.same()
    for i in range(0, 800, 7):
        for j in range(0, 800, 11):
            if s.key[i] == s.key[j]:
                one, other = (texts[s.stretch[k]].split()[s.offset[k] : s.offset[k] + 5] for k in (i, j))
                assert (one == other) == (of[i] == of[j])


def test_suffix_finds_all_repeated_passages(spark):
    rng = random.Random(11)
    shared = [words(rng, k) for k in (60, 90, 51, 50, 49, 300)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randrange(1, 4)):
            w += words(rng, rng.randrange(5, 120))
            if rng.random() < 0.6:
                w += rng.choice(shared)
        rows.append((i, " ".join(w)))
    rows += [(80, rows[3][1]), (81, rows[3][1].replace(" ", "\n", 30)), (82, "yes no " * 200), (3, rows[3][1])]
    found = suffix.repeated_passages(documents(spark, rows)).collect()
    got = {i: set() for i, _ in rows}
    for r in found:
        got[r.doc_id] |= set(range(r.start, r.end))
    want = {i: set() for i, _ in rows}
    for (i, _), gone in brute_passages(rows, 50).items():
        want[i] |= gone
    assert got == want
    by_id = {i: t.split() for i, t in rows}
    for r in found:
        kept = " " + " ".join(by_id[r.kept_in]) + " "
        assert f" {' '.join(by_id[r.doc_id][r.start : r.start + 50])} " in kept
    cut = {r.doc_id: r.text.split() for r in suffix.dedup(documents(spark, rows)).collect()}
    for i, w in by_id.items():
        assert cut.get(i, []) == [x for k, x in enumerate(w) if k not in want[i]]


def test_suffix_edges(spark):
    text = " ".join(words(random.Random(1), 70))
    rows = [(i, t, len(t or ""), "x") for i, t in enumerate(AWKWARD)] + [(None, text, 1, "x"), (60, text, 1, "x"), (60, text, 1, "x"), (61, text + " more", 1, None)]
    docs = documents(spark, rows, "doc_id long, text string, n_chars long, row string")
    kept = suffix.dedup(docs, length="n_chars")
    assert kept.columns == docs.columns
    found = kept.collect()
    assert Counter(r.doc_id for r in found) == Counter([*range(len(AWKWARD)), None, 60, 60, 61])
    assert next(r.text for r in found if r.doc_id == 61).split() == ["more"]
    assert all(r.n_chars == len(r.text) for r in found if r.text is not None)
    assert suffix.dedup(documents(spark, [])).count() == 0


# Mixing (10)


def brute_mix(rows, weights=None, total=None, others=0, seed=mixing.SEED):
    import hashlib
    import math

    per: dict = {}
    for i, source, text in rows:
        per.setdefault(source, Counter())[i] += len((text or "").split())
    n = {s: sum(c.values()) for s, c in per.items()}
    if weights is None:
        part = {s: n[s] ** 0.875 * max(n.values()) ** 0.125 if n[s] else 0 for s in n}
        if total is not None:
            part = {s: p / sum(part.values()) * total for s, p in part.items()}
    else:
        w = {s: weights.get(s, others) if n[s] else 0 for s in n}
        part = {s: (sum(n.values()) if total is None else total) * w[s] / sum(w.values()) for s in n}
    out = Counter()
    for s, c in per.items():
        budget = math.floor(round(part[s], 6))
        whole = budget // n[s] if n[s] else int(weights is None)
        rest = budget - whole * n[s]
        upto = 0
        for i in sorted(c, key=lambda i: (hashlib.md5(f"{seed}|{'' if i is None else i}".encode()).hexdigest()[:16], -1 if i is None else i)):
            upto += c[i]
            out[i, s] += whole + int(rest > 0 and upto <= rest)
    return Counter({k: v for k, v in out.items() if v})


@pytest.mark.parametrize(
    "weights,total,others,sent",
    [(None, None, 0, 10), (None, 9000, 0, 0), ({"a": 3, "b": 1}, 5000, 0, 10), ({"a": 1, "b": 1, "c": 2}, None, 0, 0), ({"a": 0.5, "zz": 9}, None, 3, 10), ({}, 700, 1, 0)],
)
def test_mixing_meets_budgets(spark, weights, total, others, sent):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c"]), " ".join(words(rng, rng.randrange(1, 60)))) for i in range(200)]
    docs = documents(spark, rows, "doc_id long, source string, text string")
    got = Counter((r.doc_id, r.source) for r in mixing.mix(docs, weights, total, epoch="e", others=others, sent_sources=sent).collect())
    assert got == brute_mix(rows, weights, total, others)


def test_mixing_edges(spark):
    rows = [(i, "s" if i % 2 else None, t, 1) for i, t in enumerate(AWKWARD)] + [(None, "s", "a b c", 1), (70, "t", None, 1), (71, "t", "", 2), (5, "s", "a b", 3)]
    docs = documents(spark, rows, "doc_id long, source string, text string, epochs int")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    keys = {(r[0], r[1]) for r in rows}
    assert {(r.doc_id, r.source) for r in mixed.select("doc_id", "source").collect()} == keys
    assert mixing.mix(documents(spark, [], "doc_id long, source string, text string")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s": -1.0})
