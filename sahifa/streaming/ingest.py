"""Incremental ingestion: a stream of items becomes versions of postings; readers take the newest of each item.

Every micro-batch is written under its own number (`batch=N`), so a batch that runs again after a failure replaces
itself, and nothing that was written before is rewritten. Items whose hash hasn't changed aren't analysed again.
A deleted item is a version like any other, without postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analyzer import DEFAULT, AnalyzerOptions
from ..operators.index import Index, build_index, postings_of
from ..sources.sinks import latest, table_or_none

ITEM_SCHEMA = "field string, rowid long, book_id long, item_id long, text string, source_deleted int"
KEYS = ["field", "rowid"]


def read_items(spark: SparkSession, folder: str, kind: str = "json", files_at_once: int | None = None) -> DataFrame:
    """The stream of item files that come into a folder."""
    reader = spark.readStream.schema(ITEM_SCHEMA)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.format(kind).load(folder)


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    return table_or_none(spark, f"{path}/items")


def write_batch(path: str, options: AnalyzerOptions = DEFAULT):
    """What foreachBatch calls: write the batch's new versions and their postings."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Of an item that is in a batch twice, the row that sorts last counts.
        batch = batch.withColumn("source_sha1", F.sha2(F.concat_ws("|", F.coalesce("text", F.lit("")), "book_id", "item_id", F.coalesce("source_deleted", F.lit(0))), 256))
        new = latest(batch, KEYS, ["source_sha1"]).withColumn("version", F.lit(number).cast("long"))
        held = _versions(spark, path)
        if held is not None:
            # Only the history of items that came again is put in order.
            again = held.where(F.col("batch") < number).join(new.select(*KEYS), KEYS, "left_semi")
            known = latest(again, KEYS, ["version"]).select(*KEYS, "source_sha1")
            new = new.join(known, [*KEYS, "source_sha1"], "left_anti")
        target = f"{path}/items/batch={number}"
        new.select(*KEYS, "book_id", "item_id", "text", "source_deleted", "source_sha1", "version").write.mode("overwrite").parquet(target)
        live = spark.read.parquet(target).where("coalesce(source_deleted, 0) = 0")
        postings_of(live, options).withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return run


def start(items: DataFrame, path: str, checkpoint: str, options: AnalyzerOptions = DEFAULT, available_now: bool = True) -> StreamingQuery:
    """Ingest a stream; the checkpoint folder lets it go on where it stopped."""
    writer = items.writeStream.foreachBatch(write_batch(path, options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_items(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every item that isn't deleted."""
    held = _versions(spark, path)
    if held is None:
        return spark.createDataFrame([], ITEM_SCHEMA + ", source_sha1 string, version long")
    return latest(held.drop("batch"), KEYS, ["version"]).where("coalesce(source_deleted, 0) = 0")


def current_postings(spark: SparkSession, path: str) -> DataFrame:
    """The postings of the items' newest versions."""
    rows = spark.read.parquet(f"{path}/postings").drop("batch")
    return rows.join(current_items(spark, path).select(*KEYS, "version"), [*KEYS, "version"], "left_semi").drop("version")


def compact(spark: SparkSession, path: str, target: str, options: AnalyzerOptions = DEFAULT) -> Index:
    """An index of the items as they are now."""
    return build_index(current_items(spark, path), target, options)
