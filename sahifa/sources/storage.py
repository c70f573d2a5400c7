"""Where things are kept: the folder that all executors share, and this package on Python workers' path."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="sahifa-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def spread(scan: DataFrame) -> DataFrame:
    """A table's scan in at least as many partitions as there are cores. Large tables come so; only small ones are moved."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)
