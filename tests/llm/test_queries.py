"""The registered queries of operators 2, 6, 8 and 9 against brute force over a whole table."""

import io
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from sahifa.llm import quality, simhash, suffix, warc
from sahifa.llm.components import local_roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_suffix_query(spark, texts):
    first, gone = {}, defaultdict(set)
    for i in sorted(texts):
        w = texts[i].split()
        for p in range(len(w) - suffix.WORDS + 1):
            if first.setdefault(tuple(w[p : p + suffix.WORDS]), (i, p)) != (i, p):
                gone[i] |= set(range(p, p + suffix.WORDS))
    got = defaultdict(set)
    for r in suffix.query(spark, SF).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
        passage = tuple(texts[r.doc_id].split()[r.start_word : r.start_word + suffix.WORDS])
        assert first[passage][0] == r.kept_in
    assert gone and got == gone


def test_simhash_query(spark, texts):
    ids = sorted(texts)
    at, prints = simhash.fingerprints_of(pa.array([texts[i].lower() for i in ids]))
    far = sum(np.bitwise_count(prints[:, None, k] ^ prints[None, :, k]).astype(int) for k in range(2))
    nodes, roots = local_roots(*(np.array(ids)[at][x] for x in np.nonzero(far <= simhash.MOST_BITS)))
    want = {(n, r) for n, r in zip(nodes.tolist(), roots.tolist()) if n != r}
    assert want and {(r.doc_id, r.duplicate_of) for r in simhash.query(spark, SF).collect()} == want


def by_definition(field, x):
    """Each line's probability of label 1 in one document, by sums over all labels of the lines before and after it."""
    score = ((x - field.mean) / field.scale) @ field.weight + field.bias
    n = len(score)
    own = np.stack([np.zeros(n), score], 1)
    ahead, back = own.copy(), np.zeros((n, 2))
    for t in range(1, n):
        for j in range(2):
            ahead[t, j] += np.logaddexp(*(ahead[t - 1, i] + field.step[i, j] for i in range(2)))
    for t in range(n - 2, -1, -1):
        for i in range(2):
            back[t, i] = np.logaddexp(*(field.step[i, j] + own[t + 1, j] + back[t + 1, j] for j in range(2)))
    both = ahead + back
    return np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))


def test_quality_query(spark, texts):
    field = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = {}
    for i, t in texts.items():
        _, length, x = quality.line_features(pa.array([t]))
        if len(x):
            p = by_definition(field, x)
            want[i] = (float((p * length).sum() / length.sum()), len(x), int((p < 0.5).sum()))
    found = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    assert set(found) == {i for i, (q, _, _) in want.items() if q >= quality.THRESHOLD} and len(found) < len(texts)
    for i, r in found.items():
        assert abs(r.quality - want[i][0]) < 1e-6 and (r.n_lines, r.n_bad_lines) == want[i][1:]


def test_the_sample_has_so_many_lines_at_most(spark):
    docs = spark.createDataFrame([(i, "good words here.\n" * 10 if i % 2 else "@@@ ###\n" * 10) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert quality.train(docs, labels, sample_lines=5).weight.tolist() == quality.Field().weight.tolist()
    assert quality.train(docs, labels, sample_lines=100).weight.any()


def test_warc_query(spark):
    """Each bundle is one file of whole records; index entries lead to each by one frame."""
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    frames = defaultdict(list)
    for r in sorted(warc.query(spark, SF).collect(), key=lambda r: (r.bundle, r.frame)):
        frames[r.bundle].append(r)
    seen = {}
    for rows in frames.values():
        data = b"".join(bytes(r.data) for r in rows)
        file = io.BytesIO(data)
        table = warc.read_seek_table(file)
        assert [(x[1], x[2]) for x in table] == [(len(r.data), r.plain_bytes) for r in rows[:-1]]
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(whole) == sum(r.plain_bytes for r in rows)
        for r in rows[:-1]:
            for page, ident, offset, length in zip(r.page_ids, r.record_ids, r.offsets, r.lengths):
                headers, block = warc.read_record(file, r.frame, offset, length)
                assert headers["WARC-Record-ID"] == f"<{ident}>" and int(headers["X-Page-ID"]) == page
                seen[page] = (headers["WARC-Target-URI"], block.decode())
    assert seen == pages
