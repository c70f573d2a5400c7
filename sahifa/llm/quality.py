"""Operator 6: a linear-chain conditional random field that labels every line of a document good or bad.

A line's features are shares of capitals, symbols, digits, bars and repeated words, its words' length and its
own, and the same of the lines before and after it. The field adds weights for the labels of neighbouring
lines; its marginals come from the forward-backward recursion. A document's quality is the mean of its lines'
probabilities of being good, weighted by their length in bytes; documents of at least THRESHOLD are accepted.

It is fitted on at most SAMPLE_DOCS labelled documents, those of least hashed doc_id, as many of them as have
SAMPLE_LINES lines in all; scoring takes every line of every document. The labels are of whole
documents: at first all lines of a bad one count as bad; then only those that the field itself finds bad (or,
if none, its worst), and it is fitted again. Lines without words say nothing. A document that is null, empty
or only white space has quality 0 and is rejected. Without labelled rows of both kinds there is nothing to
learn: every document with words then has quality 0.5 and is accepted. Of a doc_id that is labelled several times the
lesser label counts. An empty table gives an empty one. Columns of any name stay as they are, unless three are named
for the scores: columns of those names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE_DOCS, SAMPLE_LINES = 3000, 400_000
THRESHOLD = 0.5
SWEEPS, RATE, RIDGE = 250, 0.08, 1e-3

_UPPER, _LETTER, _SYMBOL, _DIGIT, _BAR, _STOP = range(6)


def _lanes() -> list[np.ndarray]:
    """Three tables from bytes to two 32-bit counters each."""
    of = np.zeros((6, 256), np.uint64)
    for b in range(256):
        c = chr(b)
        of[_UPPER, b] = b < 128 and c.isupper()
        of[_LETTER, b] = b >= 128 or c.isalpha()
        of[_DIGIT, b] = b < 128 and c.isdigit()
        of[_BAR, b] = c == "|"
        of[_STOP, b] = c in ".,;:?!'-()\""
        of[_SYMBOL, b] = 32 < b < 128 and not c.isalnum() and c not in ".,;:?'-()\""
    return [of[i] | (of[i + 1] << np.uint64(32)) for i in (0, 2, 4)]


_LANES = _lanes()
OWN = 10


def line_features(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with words in a text column: their row, their length in bytes, and their features.

    The features are OWN of the line, OWN of the line before, OWN of the next one, and whether there are such.
    """
    raw, starts = common.string_bytes(array)
    first, last = common.word_bounds(raw, starts[1:-1])
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3 * OWN + 2))
    ends = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([starts[:-1][np.diff(starts) > 0], ends + 1]))
    line = np.searchsorted(begin, first, side="right") - 1
    used, line = np.unique(line, return_inverse=True)
    begin = np.append(begin, len(raw))
    lo, hi = begin[used], begin[used + 1]
    row = np.searchsorted(starts, lo, side="right") - 1
    counts = []
    for lane in _LANES:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(lane[raw], out=sums[1:])
        both = sums[hi] - sums[lo]
        counts += [(both & np.uint64(0xFFFFFFFF)).astype(float), (both >> np.uint64(32)).astype(float)]
    n = len(used)
    words = np.bincount(line, minlength=n).astype(float)
    size = last - first
    hashes = common.word_hashes(raw, first, last)
    again = np.zeros(len(first), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    length = (hi - lo).astype(float)
    letters = np.maximum(counts[_LETTER], 1)
    mean = np.bincount(line, weights=size, minlength=n) / words
    tail = np.zeros(n, np.int64)
    tail[line] = last - 1
    own = np.empty((n, OWN))
    own[:, 0] = counts[_UPPER] / letters
    own[:, 1] = np.minimum(counts[_SYMBOL] / words, 4)
    own[:, 2] = counts[_DIGIT] / length
    own[:, 3] = counts[_BAR] / words
    own[:, 4] = np.bincount(line, weights=again, minlength=n) / words
    own[:, 5] = np.minimum(counts[_STOP] / words, 2)
    own[:, 6] = np.minimum(mean, 40) / 10
    own[:, 7] = np.log1p(words) / 5
    own[:, 8] = np.isin(raw[tail], np.frombuffer(b".?!:;", np.uint8))
    own[:, 9] = counts[_LETTER] / length
    before = np.concatenate([[False], row[1:] == row[:-1]])
    after = np.concatenate([row[1:] == row[:-1], [False]])
    x = np.zeros((n, 3 * OWN + 2))
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1] * before[1:, None]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:] * after[:-1, None]
    x[:, -2], x[:, -1] = before, after
    return row, hi - lo, x


class Field:
    """The field's weights. Labels: 1 good, 0 bad; step[i, j] is for a line of label i before one of label j."""

    def __init__(self, features: int = 3 * OWN + 2):
        self.weight, self.bias, self.step = np.zeros(features), 0.0, np.zeros((2, 2))
        self.mean, self.scale = np.zeros(features), np.ones(features)

    def marginals(self, x: np.ndarray, row: np.ndarray, pairs: bool = False):
        """Each line's probability of being good; with pairs, also those of the labels of it and the next line."""
        n = len(x)
        score = ((x - self.mean) / self.scale) @ self.weight + self.bias
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(begin, n))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        (bb, bg), (gb, gg) = self.step
        ahead, back = score.copy(), np.zeros(n)
        most = int(size[0])
        alive = np.searchsorted(-size, -np.arange(1, most + 1), side="right")
        for t in range(1, most):
            at = begin[: alive[t]] + t
            r = ahead[at - 1]
            ahead[at] = score[at] + np.logaddexp(r + gg, bg) - np.logaddexp(r + gb, bb)
        for t in range(most - 2, -1, -1):
            at = begin[: alive[t + 1]] + t
            v = score[at + 1] + back[at + 1]
            back[at] = np.logaddexp(v + gg, gb) - np.logaddexp(v + bg, bb)
        good = 1 / (1 + np.exp(-np.clip(ahead + back, -500, 500)))
        if not pairs:
            return good
        at = np.flatnonzero(row[1:] == row[:-1])
        v = score[at + 1] + back[at + 1]
        logs = np.stack([np.full(len(at), bb), bg + v, gb + ahead[at], gg + ahead[at] + v])
        logs -= logs.max(0)
        p = np.exp(logs)
        return good, (p / p.sum(0)).sum(1).reshape(2, 2)

    def fit(self, x: np.ndarray, row: np.ndarray, y: np.ndarray, sweeps: int = SWEEPS) -> None:
        """Gradient ascent (Adam) on the mean log-likelihood of the lines' labels y, less a ridge."""
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z, n = (x - self.mean) / self.scale, len(x)
        same = row[1:] == row[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
        theta = np.concatenate([self.weight, [self.bias], self.step.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, sweeps + 1):
            good, pairs = self.marginals(x, row, pairs=True)
            miss = y - good
            up = np.concatenate([z.T @ miss, [miss.sum()], (seen - pairs).ravel()]) / n - RIDGE * theta
            m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up * up
            theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            self.weight, self.bias, self.step = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)


def document_scores(field: Field, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality, lines with words, and bad lines of each row of a text column."""
    n = len(array)
    row, length, x = line_features(array)
    if not len(row):
        return np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    good = field.marginals(x, row)
    weight = np.bincount(row, weights=length, minlength=n)
    quality = np.bincount(row, weights=length * good, minlength=n) / np.maximum(weight, 1)
    return quality, np.bincount(row, minlength=n), np.bincount(row, weights=good < 0.5, minlength=n).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field:
    """Fit the field on at most sample_docs labelled documents of at most sample_lines lines; features are made on the executors."""
    common.ship(docs.sparkSession)
    labels = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("__good"))
    chosen = labels.orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text")).join(F.broadcast(chosen), "__id").select("__id", "__good", "__text")
    # Rows with one doc_id count together; of at most sample_docs ids the driver gets how many lines each has.
    sizes = rows.groupBy("__id").agg(F.sum(1 + F.length("__text") - F.length(F.replace("__text", F.lit("\n"), F.lit("")))).alias("n")).orderBy(F.xxhash64("__id"), "__id").collect()
    upto = np.cumsum([r["n"] for r in sizes]) if sizes else np.zeros(0)
    kept = {int(r["__id"]) for r, total in zip(sizes, upto) if total <= sample_lines}
    if len(kept) < len(sizes):
        rows = rows.where(F.col("__id").isin(sorted(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "__text"):
            row, length, x = line_features(batch.column(2))
            at = pa.array(row)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at).cast(pa.int32()), lists], names=["id", "good", "x"])

    found = rows.mapInArrow(common.forgetting(run), "id long, good int, x array<float>").toArrow()
    field = Field()
    good = found.column("good").to_numpy()
    if len(set(good.tolist())) < 2:
        return field
    x = np.asarray(found.column("x").combine_chunks().flatten(), float).reshape(len(found), -1)
    _, row = np.unique(found.column("id").to_numpy(), return_inverse=True)
    order = np.argsort(row, kind="stable")
    x, row, good = x[order], row[order], good[order].astype(np.int64)
    field.fit(x, row, good)
    p = field.marginals(x, row)
    worst = np.ones(row[-1] + 1)
    np.minimum.at(worst, row, p)
    y = np.where((good == 0) & ((p < 0.5) | (p == worst[row])), 0, 1)
    if y.min() == y.max():
        return field
    again = Field()
    again.fit(x, row, y)
    return again


def score(docs: DataFrame, field: Field, text: str = "text", quality: str = "quality", lines: str = "n_lines", bad: str = "n_bad_lines") -> DataFrame:
    """docs with three columns more, which replace columns of these names; one pass, no shuffle."""
    docs = common.without(docs, quality, lines, bad)
    schema = T.StructType([*docs.schema.fields, T.StructField(quality, T.DoubleType()), T.StructField(lines, T.LongType()), T.StructField(bad, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, text):
            found = document_scores(field, batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[f.name for f in schema])

    return docs.mapInArrow(common.forgetting(run), schema)


def accept(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS, scores: tuple[str, ...] = ()) -> DataFrame:
    """The accepted rows of docs; scores: names of three columns to keep quality, lines and bad lines in."""
    field = train(docs, labels, doc_id, text, sample_docs)
    names = scores or common.fresh(docs, "quality", "lines", "bad")
    kept = score(docs, field, text, *names).where(F.col(f"`{names[0]}`") >= threshold)
    return kept if scores else kept.drop(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """Every accepted document with its quality."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("quality", "n_lines", "n_bad_lines")
    return accept(docs, common.table(spark, sf_dir, "labels"), scores=names).select("doc_id", *names)
