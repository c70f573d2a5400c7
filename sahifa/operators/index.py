"""The inverted index as DataFrames: postings, lexicon, and the lengths that scoring needs.

A posting is one row for a term in an item, with its offsets (tokens kept) and positions (stop words count too).
The tables are written as Parquet in order of (field, term), so that a term's scan skips all other row groups,
and a term that is in most items is still split over many files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..functions.analyzer import DEFAULT, SENTINEL, AnalyzerOptions, Token, analyzer
from ..sources.pieces import pieces
from ..sources.storage import ship

DOC_SCHEMA = "field string, rowid long, book_id long, item_id long, text string"
POSTING_SCHEMA = "field string, term string, rowid long, book_id long, item_id long, tf int, offsets array<int>, positions array<int>"
TABLES = ("docs", "postings", "vocab", "book_lengths", "row_lengths", "stats")


@dataclass(frozen=True)
class FieldStats:
    """doc_count: books with tokens; item_count: items; tokens: of all items."""

    doc_count: int = 0
    item_count: int = 0
    tokens: int = 0

    @property
    def avgdl(self) -> float:
        return self.tokens / self.doc_count if self.doc_count else 0.0

    @property
    def row_avgdl(self) -> float:
        return self.tokens / self.item_count if self.item_count else 0.0


def _plain_positions(texts: list[str | None], row: np.ndarray, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The positions by the default options of each posting's term: all values, and where each posting's begin, and the end."""
    places = [analyzer().places(text) for text in texts]
    found = [places[r].get(t, ((), ()))[1] for r, t in zip(row, terms)]
    return np.array([p for x in found for p in x], np.int32), np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))


def postings_of(docs: DataFrame, options: AnalyzerOptions = DEFAULT) -> DataFrame:
    """docs' postings: one pass in pieces of Arrow batches, no shuffle. Null and empty texts have none."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, terms, term, *lists = analyzer(options).places_of(batch.column(4).to_pylist())
            at, tf = pa.array(row, pa.int32()), np.diff(lists[0][1])
            if options != DEFAULT:
                # Phrases are counted by the positions that queries have.
                lists[1] = _plain_positions(batch.column(4).to_pylist(), row, [terms[t] for t in term])
            field_, rowid, book, item = (batch.column(i).take(at) for i in range(4))
            offsets, positions = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())) for values, ends in lists)
            yield pa.RecordBatch.from_arrays([field_, pa.array(terms, pa.string()).take(pa.array(term)), rowid, book, item, pa.array(tf, pa.int32()), offsets, positions], names=["field", "term", "rowid", "book_id", "item_id", "tf", "offsets", "positions"])

    return docs.select("field", "rowid", "book_id", "item_id", "text").mapInArrow(run, POSTING_SCHEMA)


def tokens_of(docs: DataFrame, options: AnalyzerOptions = DEFAULT) -> DataFrame:
    """(field, rowid, term, offset, position, start, end) of every token."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = analyzer(options)
        for batch in pieces(batches):
            row: list[int] = []
            out: list[Token] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = own.tokens(text, document=True)
                row += [i] * len(found)
                out += found
            at = pa.array(row, pa.int32())
            columns_ = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(columns_[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns_[1:])], names=["field", "rowid", "term", "offset", "position", "start", "end"])

    return docs.select("field", "rowid", "text").mapInArrow(run, "field string, rowid long, term string, offset int, position int, start int, end int")


def vocab_of(postings: DataFrame) -> DataFrame:
    """(field, term, doc, cnt): items that hold the term, and how often in all."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("doc"), F.sum("tf").cast("long").alias("cnt"))


def row_lengths_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "rowid", "book_id").agg(F.sum("tf").cast("long").alias("len"))


def book_lengths_of(row_lengths: DataFrame) -> DataFrame:
    return row_lengths.groupBy("field", "book_id").agg(F.sum("len").cast("long").alias("len"))


def with_norms(book_lengths: DataFrame, stats: DataFrame) -> DataFrame:
    """(field, book_id, len, norm): what scoring multiplies a frequency by, worked out once for each book."""
    avgdl = F.when(F.col("doc_count") > 0, F.col("tokens") / F.col("doc_count")).otherwise(0.0)
    joined = book_lengths.join(F.broadcast(stats.select("field", avgdl.alias("avgdl"))), "field")
    return joined.select("field", "book_id", "len", columns.norm_inverse(columns.quantised(F.col("len")), F.col("avgdl")).alias("norm"))


def stats_of(docs: DataFrame, book_lengths: DataFrame) -> DataFrame:
    """(field, doc_count, item_count, tokens)."""
    books = book_lengths.groupBy("field").agg(F.count("*").alias("doc_count"), F.sum("len").cast("long").alias("tokens"))
    items = docs.groupBy("field").agg(F.count("*").alias("item_count"))
    return items.join(books, "field", "left").select("field", F.coalesce("doc_count", F.lit(0)).cast("long").alias("doc_count"), "item_count", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


@dataclass
class Index:
    """The tables of an index, read where they were written, and what the driver knows of them."""

    spark: SparkSession
    path: str
    options: AnalyzerOptions = DEFAULT
    stats: dict[str, FieldStats] = field(default_factory=dict)
    _doc_freq: dict[tuple[str, str], int] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def postings(self, name: str) -> DataFrame:
        return self.table("postings").where(F.col("field") == name)

    def vocab(self, name: str) -> DataFrame:
        """The field's lexicon, without sentinels."""
        return self.table("vocab").where((F.col("field") == name) & (F.col("term") != SENTINEL))

    def docs(self, name: str) -> DataFrame:
        return self.table("docs").where(F.col("field") == name)

    def book_lengths(self, name: str) -> DataFrame:
        return self.table("book_lengths").where(F.col("field") == name).select("book_id", F.col("len").alias("book_len"), "norm")

    def row_lengths(self, name: str) -> DataFrame:
        return self.table("row_lengths").where(F.col("field") == name).select("rowid", F.col("len").alias("row_len"))

    def field_stats(self, name: str) -> FieldStats:
        return self.stats.get(name, FieldStats())

    def doc_freqs(self, name: str, terms: list[str]) -> dict[str, int]:
        """In how many items each term is; one small job for those not asked before."""
        new = [t for t in dict.fromkeys(terms) if (name, t) not in self._doc_freq]
        if new:
            known = {r.term: r.doc for r in self.table("vocab").where((F.col("field") == name) & F.col("term").isin(new)).select("term", "doc").collect()}
            self._doc_freq |= {(name, t): known.get(t, 0) for t in new}
        return {t: self._doc_freq[name, t] for t in terms}

    def expand_pattern(self, name: str, pattern: str, most: int) -> list[str]:
        """The first `most` terms, in byte order, that the pattern matches whole."""
        rows = self.vocab(name).where(columns.glob_match(F.col("term"), pattern)).select("term").orderBy("term").limit(most)
        return [r.term for r in rows.collect()]

    def expand_substring(self, name: str, pattern: str, most: int) -> list[str]:
        """The first `most` terms that the pattern occurs in."""
        rows = self.vocab(name).where(columns.wildcard_match(F.col("term"), pattern)).select("term").orderBy("term").limit(most)
        return [r.term for r in rows.collect()]

    def expand_edits(self, name: str, term: str, edits: int, most: int) -> list[str]:
        """The first `most` terms of the whole lexicon within so many edits."""
        near = self.vocab(name).where(columns.levenshtein_capped(F.lit(term), F.col("term"), edits) <= edits)
        return [r.term for r in near.select("term").orderBy("term").limit(most).collect()] if term else []

    def expand_fuzzy(self, name: str, term: str, edits: int, most: int) -> list[str]:
        """Of the first max(512, 8 * most) terms of about this length, the first `most` within so many edits."""
        if not term:
            return []
        size = F.length("term")
        near = self.vocab(name).where(size.between(max(1, len(term) - edits), len(term) + edits)).select("term").orderBy("term").limit(max(512, 8 * most))
        near = near.where(columns.levenshtein_capped(F.lit(term), F.col("term"), edits) <= edits).orderBy("term").limit(most)
        return [r.term for r in near.collect()]


def build_index(docs: DataFrame, path: str, options: AnalyzerOptions = DEFAULT, mode: str = "overwrite") -> Index:
    """Write the tables of docs (field, rowid, book_id, item_id, text) under path."""
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in DOC_SCHEMA.split(", ")])
    docs.write.mode(mode).parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    # Written once in document order: the analyser runs once, and everything else reads its result.
    postings_of(docs, options).write.mode(mode).parquet(f"{path}/by_item")
    by_item = spark.read.parquet(f"{path}/by_item")
    by_item.repartitionByRange("field", "term", "rowid").sortWithinPartitions("field", "term", "rowid").write.mode(mode).parquet(f"{path}/postings")
    row_lengths_of(by_item).write.mode(mode).parquet(f"{path}/row_lengths")
    postings = spark.read.parquet(f"{path}/postings")
    vocab_of(postings).repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode(mode).parquet(f"{path}/vocab")
    lengths = book_lengths_of(spark.read.parquet(f"{path}/row_lengths"))
    stats_of(docs, lengths).write.mode(mode).parquet(f"{path}/stats")
    with_norms(lengths, spark.read.parquet(f"{path}/stats")).write.mode(mode).parquet(f"{path}/book_lengths")
    return load_index(spark, path, options)


def load_index(spark: SparkSession, path: str, options: AnalyzerOptions = DEFAULT) -> Index:
    ship(spark)
    rows = spark.read.parquet(f"{path}/stats").collect()
    return Index(spark, path, options, {r.field: FieldStats(r.doc_count, r.item_count, r.tokens) for r in rows})
