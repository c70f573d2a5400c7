"""Operator 9: SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has 128 bits: bit i is the majority of bit i in the hashes of its distinct words
(lower case, runs of letters and digits). Two documents are near-duplicates if their fingerprints differ in
at most MOST_BITS bits, and groups are the connected components of that.

Candidates: five segments of 23 bits are decoded by the perfect (23, 12, 7) Golay code. A segment at a
distance of up to 2 from a codeword has that codeword's 12-bit index as its one key; one at a distance of 3
has six, its own and those of the five codewords at a distance of 4. Then any two segments that differ in
at most 2 bits share a key, and by the pigeonhole principle fingerprints that differ in at most 11 of the 115
bits do so in at least two segments. Keys are pairs of segments' keys (24 bits), since single ones would
put every 4096th of the corpus in one bucket. Rows that share a key are compared in all 128 bits. Beyond
the 11 bits the search is approximate: of random pairs that differ in 12, 14, 16, 18 of the 128 bits it finds
all, all, 0.99, 0.98.

A document with null text or without words is in no group. Rows with the same doc_id are one document and
stay or go together; rows with a null doc_id always stay. Of a group the least doc_id stays. An empty table gives
an empty one. Columns of any name stay as they are: the operator's own get names that docs lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, local_roots

MOST_BITS = 18
SEGMENTS = 5
GENERATOR = 0b101011100011
#: Groups of up to this many rows with one key are compared pair by pair at once, larger ones by spreading.
PAIRWISE = 24
#: Distances worked out at a time.
CELLS = 1 << 21

_WORDLESS = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def syndrome(v: np.ndarray) -> np.ndarray:
    """Of 23-bit words, the remainder by the Golay code's generator polynomial."""
    v = np.asarray(v, np.int64).copy()
    for bit in range(22, 10, -1):
        v ^= ((v >> bit) & 1) * (GENERATOR << (bit - 11))
    return v


def _patterns() -> np.ndarray:
    """For each syndrome the error patterns that lead to the codewords whose indices are the keys; -1 fills up."""
    table = np.full((2048, 6), -1, np.int64)
    found: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for e, s in zip(errors.tolist(), syndrome(errors).tolist()):
            found[s].append((weight, e))
    for s, each in enumerate(found):
        each.sort()
        keep = each[:1] if each[0][0] <= 2 else each
        table[s, : len(keep)] = [e for _, e in keep]
    return table


_tables: list[np.ndarray] = []


def segment_keys(v: np.ndarray) -> np.ndarray:
    """n x 6 codeword indices of 23-bit words, -1 where there are fewer."""
    if not _tables:
        _tables.append(_patterns())
    errors = _tables[0][syndrome(v)]
    return np.where(errors < 0, -1, (v[:, None] ^ errors) >> 11)


def fingerprints_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows with words, and their fingerprints as n x 2 words of 64 bits, of lower-case texts."""
    raw, starts = common.string_bytes(array)
    first, last = common.word_bounds(raw, starts[1:-1], _WORDLESS)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    doc = np.searchsorted(starts, first, side="right") - 1
    # A row's distinct words: 44 bits of hash behind the row's number, sorted.
    keys = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (common.word_hashes(raw, first, last) >> np.uint64(20)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    doc = (keys >> np.uint64(44)).astype(np.int64)
    word = keys & np.uint64((1 << 44) - 1)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(begin, len(doc)))
    out = np.zeros((len(begin), 2), np.uint64)
    for part in range(2):
        bits = np.unpackbits(common.mix64(word * np.uint64(2) + np.uint64(part + 1)).view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        out[:, part] = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64).ravel()
    return doc[begin], out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, p0, p1) of the documents that have words; one pass, no shuffle."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "words"):
            rows, prints = fingerprints_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(prints[:, i].view(np.int64)) for i in range(2))], names=["id", "p0", "p1"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.lower(F.col(f"`{text}`")).alias("words"))
    return rows.where("id is not null and words is not null").mapInArrow(common.forgetting(run), "id long, p0 long, p1 long")


def bucket_keys(p0: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every pair of segments' keys."""
    low = np.uint64((1 << 23) - 1)
    # The fifth segment: 18 of the bits that the others leave in p0, and five of those in p1.
    rest = (p0 >> np.uint64(46)) | ((p1 >> np.uint64(46)) << np.uint64(18))
    words = [p >> np.uint64(s) for p in (p0, p1) for s in (0, 23)] + [rest]
    parts = [segment_keys((w & low).astype(np.int64)) for w in words]
    rows, keys = [], []
    for n, (i, j) in enumerate(combinations(range(SEGMENTS), 2)):
        a, b = parts[i][:, :, None], parts[j][:, None, :]
        good = (a >= 0) & (b >= 0)
        key = ((n << 24) | (a << 12) | b)[good]
        keys.append(key.astype(np.int32))
        rows.append(np.nonzero(good)[0])
    return np.concatenate(rows), np.concatenate(keys)


def _distance(p0: np.ndarray, p1: np.ndarray, a, b) -> np.ndarray:
    return np.bitwise_count(p0[a] ^ p0[b]) + np.bitwise_count(p1[a] ^ p1[b])


def _near(p0: np.ndarray, p1: np.ndarray, rows: np.ndarray, others: np.ndarray, most: int) -> np.ndarray:
    return _distance(p0, p1, rows[:, None], others[None, :]) <= most


def _large(rows: np.ndarray, p0: np.ndarray, p1: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a bucket: a block of rows is compared with all; rows near to many take these in, and what is near to them, and so on."""
    while len(rows) > 1:
        step = max(1, min(256, CELLS // len(rows)))
        near = _near(p0, p1, rows[:step], rows, most)
        np.fill_diagonal(near, False)
        many = near.sum(1) > PAIRWISE
        # Of rows near to few, all links.
        a, b = np.nonzero(near & ~many[:, None])
        yield rows[a], rows[b]
        wide, rows = rows[:step][many], np.concatenate([rows[:step][many], rows[step:]])
        while len(wide):
            front, rows = wide[:1], rows[rows != wide[0]]
            while len(front) and len(rows):
                step = max(1, min(256, CELLS // len(rows)))
                near = _near(p0, p1, front[:step], rows, most)
                found = near.any(0)
                yield front[:step][near.argmax(0)[found]], rows[found]
                front, rows = np.concatenate([front[step:], rows[found]]), rows[~found]
            wide = wide[np.isin(wide, rows)]


def bucket_links(key: np.ndarray, p0: np.ndarray, p1: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect all that pairs of rows with one key and at most `most` differing bits connect."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(k)))
    left, right = [], []
    # Small buckets: all pairs, one distance in the order at a time.
    of = np.repeat(size, size)
    rest = np.repeat(begin + size, size)
    small = np.flatnonzero((of > 1) & (of <= PAIRWISE))
    for d in range(1, PAIRWISE):
        small = small[small + d < rest[small]]
        if not len(small):
            break
        a, b = order[small], order[small + d]
        near = _distance(p0, p1, a, b) <= most
        left.append(a[near])
        right.append(b[near])
    for g in np.flatnonzero(size > PAIRWISE):
        for a, b in _large(order[begin[g] : begin[g] + size[g]], p0, p1, most):
            left.append(a)
            right.append(b)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS, scratch: common.Scratch | None = None) -> DataFrame:
    """(doc_id, duplicate_of): each document that another one stands for, the least doc_id of its group."""
    spark = docs.sparkSession
    scratch = scratch or common.Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(docs, doc_id, text), "prints")
    # Equal fingerprints first: only one document of each goes on.
    firsts = scratch.write(prints.groupBy("p0", "p1").agg(F.min("id").alias("first")), "firsts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                p0, p1 = (part.column(i).to_numpy().view(np.uint64) for i in range(2))
                rows, keys = bucket_keys(p0, p1)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(pa.array(rows)) for c in part.columns)], names=["key", "p0", "p1", "first"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        del parts
        p0, p1 = (t.column(c).to_numpy().view(np.uint64) for c in ("p0", "p1"))
        first = t.column("first").to_numpy()
        a, b = bucket_links(t.column("key").to_numpy(), p0, p1, most_bits)
        nodes, roots = local_roots(first[a], first[b])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])

    spreadable = firsts.repartition(common.partitions(spark))
    keyed = spreadable.mapInArrow(spread, "key int, p0 long, p1 long, first long")
    pairs = keyed.repartition(2 * common.partitions(spark), "key").mapInArrow(link, "a long, b long")
    roots = scratch.write(components(pairs, scratch), "roots")
    members = prints.join(firsts, ["p0", "p1"]).select("id", "first")
    out = members.join(roots, members["first"] == roots["node"], "left").select("id", F.coalesce("root", "first").alias("root"))
    return out.where("id <> root").distinct().select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS, sent_keys: int = common.SENT_KEYS) -> DataFrame:
    """docs without the documents that another one stands for."""
    scratch, (name,) = common.Scratch(docs.sparkSession, "simhash"), common.fresh(docs, "gone")
    gone = scratch.write(near_duplicates(docs, doc_id, text, most_bits, scratch).select(F.col("doc_id").alias(name)), "gone")
    scratch.drop("prints", "firsts", "roots", "pairs")
    # Ids are sent to the texts as long as they are few enough, so that the texts aren't shuffled.
    if gone.count() <= sent_keys:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document that goes, with the one that stays for it."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
