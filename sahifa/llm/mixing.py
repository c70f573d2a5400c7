"""Operator 10: mixing sources to target weights by hash-random keys, a range sort and prefix sums of tokens.

Every document gets a random-looking key, a hash of a seed and its doc_id. Within each source the documents
are range-sorted by key and their token counts (runs of bytes other than ASCII white space) summed up: a sum in
each partition, plus the sums of the partitions before. A source with a budget of b tokens out of n gives
floor(b / n) whole epochs, then the longest run of documents in key order whose tokens fit into the rest: no
source goes over its budget, nor under it by a whole document. The cut is one key for each source, so the
texts themselves aren't shuffled.

Weights are given by source, and one for each source that isn't named (nothing, by default). A source's budget is
its weight's share, among those of the sources that have tokens, of total_tokens, or of the corpus's tokens where no
total is given; so a source may be cut below an epoch or repeated. Without weights they are the sources'
tokens to the power of 7/8, and the total is the least at which every document appears at least once: large
sources lose share to small ones, but no document is lost. A null source is a source like any other. Rows with
the same doc_id and source are one document, rows with a null doc_id and the same source too. A null text has no
tokens; a source without tokens gets one epoch without weights, as its budget is met by that, and none with them. An
empty table gives an empty one. Columns of any name stay as they are: the operator's own get names that docs lacks;
only a column of the name given as `epoch` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = "mix-1"
#: Cut tables of up to this many sources are sent to every executor; beyond that, documents are joined with their own decisions.
SENT_SOURCES = 50_000
#: The registered mixture: the largest source is held to a small share, two are raised, the rest are alike.
TARGET, OTHERS = {"src0": 3.0, "src1": 12.0, "src2": 8.0, "src3": 2.5}, 5.0


def key_of(doc_id: str, seed: str) -> F.Column:
    return F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))), 1, 16)


def count_words(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """(source, key, id, tokens) for each document; the text is read once."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text"):
            raw, starts = common.string_bytes(batch.column(3))
            first, _ = common.word_bounds(raw, starts[1:-1])
            n = np.diff(np.searchsorted(first, starts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n)], names=["source", "key", "id", "tokens"])

    rows = docs.select(F.col(f"`{source}`").cast("string").alias("source"), key_of(doc_id, seed).alias("key"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "source string, key string, id long, tokens long").groupBy("source", "key", "id").agg(F.sum("tokens").alias("tokens"))


def prefix_sums(rows: DataFrame, scratch: common.Scratch) -> DataFrame:
    """rows(source, key, id, tokens) with `upto`, the tokens of the source up to and with the row in order of (key, id)."""
    n = common.partitions(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            source = batch.column(0).dictionary_encode()
            code = np.asarray(source.indices.fill_null(-1))
            tokens = batch.column(3).to_numpy()
            sums = np.cumsum(tokens)
            begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            base = (sums - tokens)[begin]
            if batch.column(0)[0].as_py() == last:
                base[0] -= total
            within = sums - np.repeat(base, np.diff(np.append(begin, len(code))))
            last, total = batch.column(0)[batch.num_rows - 1].as_py(), int(within[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within)], names=["source", "key", "id", "tokens", "part", "within"])

    ordered = rows.repartitionByRange(n, "source", "key", "id").sortWithinPartitions("source", "key", "id").withColumn("part", F.spark_partition_id())
    ordered = scratch.write(ordered.mapInArrow(run, "source string, key string, id long, tokens long, part int, within long"), "ordered")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ordered.groupBy("source", "part").agg(F.sum("tokens").alias("n")).select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = ordered.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return joined.select("source", "key", "id", "tokens", (F.col("base") + F.col("within")).alias("upto"))


def budgets(totals: DataFrame, weights: dict | None, total_tokens: int | None, others: float = 0.0) -> DataFrame:
    """totals(source, n) with each source's budget."""
    n = F.col("n").cast("double")
    if weights is None:
        # n ** (7/8) * most ** (1/8), by square roots: every engine rounds those alike.
        most = F.lit(totals.agg(F.max("n")).first()[0]).cast("double")
        part = F.when(F.col("n") > 0, n * F.sqrt(F.sqrt(F.sqrt(most / n)))).otherwise(0.0)
        if total_tokens is not None:
            part = part / F.lit(totals.agg(F.sum(part)).first()[0]) * F.lit(float(total_tokens))
        return totals.withColumn("budget", F.floor(F.round(part, 6)).cast("long"))
    if min([*weights.values(), others]) < 0 or max([*weights.values(), others]) <= 0:
        raise ValueError("weights must be non-negative, and one of them positive")
    w = totals.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
    known = totals.join(w, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("w", F.when(F.col("n") > 0, F.coalesce("w", F.lit(float(others)))).otherwise(0.0))
    whole, every = known.agg(F.sum("n"), F.sum("w")).first()
    part = F.lit(float((whole or 0) if total_tokens is None else total_tokens)) * F.col("w") / F.lit(every or 1.0)
    return known.withColumn("budget", F.floor(F.round(part, 6)).cast("long")).drop("s", "w")


def cuts(docs: DataFrame, weights: dict | None, total_tokens: int | None, others: float, doc_id: str, text: str, source: str, seed: str, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(source, epochs, cut_key, cut_id) for each source, and its documents (source, key, id, tokens, upto)."""
    rows = scratch.write(count_words(docs, doc_id, text, source, seed), "words")
    totals = budgets(rows.groupBy("source").agg(F.sum("tokens").alias("n")), weights, total_tokens, others)
    whole = F.when(F.col("n") > 0, F.floor(F.col("budget") / F.col("n"))).otherwise(1).cast("int")
    plan = totals.withColumn("epochs", whole if weights is None else F.when(F.col("n") > 0, whole).otherwise(0))
    plan = plan.withColumn("rest", F.when(F.col("n") > 0, F.col("budget") - F.col("epochs") * F.col("n")).otherwise(0))
    summed = prefix_sums(rows, scratch)
    fits = summed.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    fits = fits.where("rest > 0 and upto <= rest").groupBy("source").agg(F.max(F.struct("key", F.coalesce("id", F.lit(-(2**63))).alias("id"))).alias("cut")).select(F.col("source").alias("s"), "cut")
    plan = plan.join(fits, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "epochs", F.col("cut.key").alias("cut_key"), F.col("cut.id").alias("cut_id"))
    plan = scratch.write(plan, "plan")
    scratch.drop("ordered")
    return plan, rows


def mix(docs: DataFrame, weights: dict | None = None, total_tokens: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, epoch: str | None = None, others: float = 0.0, sent_sources: int = SENT_SOURCES) -> DataFrame:
    """docs, each row as often as its source's budget has it; `epoch` names a column to number the copies in."""
    scratch = common.Scratch(docs.sparkSession, "mix")
    plan, rows = cuts(docs, weights, total_tokens, others, doc_id, text, source, seed, scratch)
    ident, of = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{source}`").cast("string")
    name = dict(zip((*plan.columns, "ident", "copies", "copy"), common.fresh(docs, *plan.columns, "ident", "copies", "copy")))
    renamed = plan.select(*[F.col(c).alias(name[c]) for c in plan.columns])

    def copies(key: F.Column, ident: F.Column) -> F.Column:
        ident = F.coalesce(ident, F.lit(-(2**63)))
        more = (key < F.col(name["cut_key"])) | ((key == F.col(name["cut_key"])) & (ident <= F.col(name["cut_id"])))
        return (F.col(name["epochs"]) + F.when(more, 1).otherwise(0)).alias(name["copies"])

    if plan.count() <= sent_sources:
        out = docs.join(F.broadcast(renamed), of.eqNullSafe(F.col(name["source"]))).select(*[F.col(f"`{c}`") for c in docs.columns], copies(key_of(doc_id, seed), ident))
    else:
        own = rows.select(F.col("source").alias("s"), "key", "id").join(renamed, F.col("s").eqNullSafe(F.col(name["source"])))
        own = own.select(F.col(name["source"]), F.col("id").alias(name["ident"]), copies(F.col("key"), F.col("id"))).where(F.col(name["copies"]) > 0)
        out = docs.join(own, ident.eqNullSafe(F.col(name["ident"])) & of.eqNullSafe(F.col(name["source"])))
    out = out.where(F.col(name["copies"]) > 0).withColumn(name["copy"], F.explode(F.sequence(F.lit(1), F.col(name["copies"]))))
    own = [F.col(f"`{c}`") for c in docs.columns if c != epoch]
    return out.select(*own, *([F.col(name["copy"]).alias(epoch)] if epoch else []))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document of the mixture, once for each epoch that it is in."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, TARGET, others=OTHERS, epoch="epoch").select("doc_id", "source", "epoch")


ORACLE_SQL = rf"""
WITH words AS (
  SELECT source, doc_id, substr(md5('mix-1|' || CAST(doc_id AS VARCHAR)), 1, 16) AS key,
         CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\t\n\x0b\x0c\r ]+'))) AS BIGINT) AS tokens
  FROM documents GROUP BY 1, 2, 3),
sums AS (
  SELECT source, doc_id, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM words),
totals AS (SELECT source, sum(tokens) AS n FROM words GROUP BY 1),
target(source, w) AS (VALUES {", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in TARGET.items())}),
weighted AS (SELECT t.source, t.n, coalesce(g.w, CAST({OTHERS} AS DOUBLE)) AS w FROM totals t LEFT JOIN target g USING (source) WHERE t.n > 0),
every AS (SELECT CAST(sum(n) AS DOUBLE) AS whole, sum(w) AS weight FROM weighted),
plan AS (SELECT source, n, CAST(floor(round(whole * w / weight, 6)) AS BIGINT) AS budget FROM weighted, every),
copies AS (
  SELECT s.source, doc_id, CAST(budget // n + CASE WHEN budget % n > 0 AND upto <= budget % n THEN 1 ELSE 0 END AS BIGINT) AS c
  FROM sums s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, CAST(unnest(range(1, c + 1)) AS INTEGER) AS epoch FROM copies
"""
