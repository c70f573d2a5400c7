"""Sinks: upserts by key, the ledger of ingest runs, and results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, tier string, manifest_version int, manifest_sha256 string, source_path string, tokenizer string, status string, started_at timestamp, completed_at timestamp, error_message string"
CHECKPOINT_SCHEMA = "stream_name string, run_id string, last_book_id long, last_source_rowid long, last_target_rowid long, updated_at timestamp"
TIERS, STATUSES, STREAMS = ("smoke", "parity", "full"), ("running", "completed", "failed"), ("pages", "titles")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by the order columns; nulls come first."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """held with the rows of new in place of those with their keys; new's keys must be unique."""
    same = [F.col(f"held.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    match = same[0]
    for s in same[1:]:
        match = match & s
    kept = held.alias("held").join(new.select(*keys).alias("new"), match, "left_anti")
    return kept.unionByName(new)


def _one_of(column: str, allowed: tuple[str, ...]):
    message = F.concat(F.lit(f"{column} isn't one of {', '.join(allowed)}: "), F.coalesce(F.col(column), F.lit("null")))
    return F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(message))


def checked_runs(rows: DataFrame) -> DataFrame:
    """Run rows; a tier or status that isn't known fails."""
    return rows.withColumns({"tier": _one_of("tier", TIERS), "status": _one_of("status", STATUSES)})


def checked_checkpoints(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stream_name", _one_of("stream_name", STREAMS))


def last_checkpoints(rows: DataFrame) -> DataFrame:
    """Where each stream goes on."""
    return latest(rows, ["stream_name"], ["updated_at", "last_source_rowid"])


def write_hits(hits: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Hits as JSON lines."""
    hits.write.mode(mode).json(path)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(conf).exists(p) else None
