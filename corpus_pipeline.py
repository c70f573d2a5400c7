"""A training corpus from raw documents: five operators of `sahifa.llm`, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sahifa.llm import bpe, common, mixing, quality, simhash, suffix


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return quality.accept(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.dedup(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before are cut; n_chars follows the text."""
    return suffix.dedup(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document is there once for each epoch that its source's budget gives it."""
    return mixing.mix(docs, mixing.TARGET, others=mixing.OTHERS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of the text."""
    return bpe.bpe_encode(docs, keep_text=False)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("source mixing", mix_sources),
    ("encoding", encode),
]

#: The classifier is fitted and the encoder is a table of merges: SQL can't express them. tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; what each gives is written to the shared folder and read again."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = scratch.write(docs, f"stage{n}")
            scratch.drop(*([f"stage{n - 1}"] if n else []))
    return docs
