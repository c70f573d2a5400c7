"""The pipeline against a version that does each stage by brute force in one process."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from sahifa.llm import bpe, mixing, quality, registry, simhash, suffix
from sahifa.llm.components import local_roots

SF = "/root/testdata/sf0.001"


def brute_run(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    score = quality.document_scores(field, pa.array([r["text"] for r in rows]))[0]
    rows = [r for r, q in zip(rows, score) if q >= quality.THRESHOLD]

    at, prints = simhash.fingerprints_of(pa.array([r["text"].lower() for r in rows]))
    ids = np.array([rows[i]["doc_id"] for i in at])
    far = sum(np.bitwise_count(prints[:, None, i] ^ prints[None, :, i]).astype(int) for i in range(2))
    a, b = np.nonzero(np.triu(far <= simhash.MOST_BITS, 1))
    nodes, roots = local_roots(ids[a], ids[b])
    gone = {n for n, r in zip(nodes.tolist(), roots.tolist()) if n != r}
    rows = [r for r in rows if r["doc_id"] not in gone]

    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        w = r["text"].split()
        cut = set()
        for p in range(len(w) - suffix.WORDS + 1):
            if first.setdefault(tuple(w[p : p + suffix.WORDS]), (r["doc_id"], p)) != (r["doc_id"], p):
                cut |= set(range(p, p + suffix.WORDS))
        r["words"] = [x for k, x in enumerate(w) if k not in cut]
        r["cut"] = bool(cut)
    rows = [r for r in rows if r["words"]]

    n = Counter()
    for r in rows:
        n[r["source"]] += len(r["words"])
    out = Counter()
    weight = {s: mixing.TARGET.get(s, mixing.OTHERS) for s in n}
    for s, total in n.items():
        budget = math.floor(round(sum(n.values()) * weight[s] / sum(weight.values()), 6))
        rest, upto = budget % total, 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (hashlib.md5(f"{mixing.SEED}|{r['doc_id']}".encode()).hexdigest()[:16], r["doc_id"])):
            upto += len(r["words"])
            out[r["doc_id"]] += budget // total + int(upto <= rest)
    encode = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={}).encode_ordinary
    out = Counter({k: v for k, v in out.items() if v})
    return out, {r["doc_id"]: None if r["cut"] else encode(r["text"]) for r in rows}, {r["doc_id"]: r["words"] for r in rows}


def test_pipeline_against_brute_force(spark):
    found = corpus_pipeline.run(spark, SF).collect()
    times, tokens, words = brute_run(spark)
    assert Counter(r.doc_id for r in found) == times
    automaton = bpe.encoder().automaton
    for r in found:
        if tokens[r.doc_id] is not None:
            assert r.tokens == tokens[r.doc_id]
        assert automaton.decode(r.tokens).split() == words[r.doc_id]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, SF).columns) == sorted(docs.columns)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and set(registry.queries()) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in registry.OPERATORS) == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
