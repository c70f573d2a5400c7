"""Readers of corpora and queries, each with a declared schema; `docs` frames are (field, rowid, book_id, item_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import spread


def jsonl_documents(spark: SparkSession, path: str) -> DataFrame:
    """Lines {doc_id, page, title}."""
    return spark.read.schema("doc_id string, page string, title string").json(path)


def jsonl_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines {id, query, top_k}."""
    return spark.read.schema("id string, query string, top_k int").json(path)


def base64_texts(spark: SparkSession, path: str) -> DataFrame:
    """Lines id TAB base64 of a text; a line that can't be decoded has a null text."""
    rows = spark.read.schema("id string, encoded string").csv(path, sep="\t", quote="")
    return rows.select("id", F.try_to_binary("encoded", F.lit("base64")).cast("string").alias("text"))


def pipe_corpus(spark: SparkSession, path: str, field: str = "page") -> DataFrame:
    """Lines book_id|item_id|text; the text may have bars. Lines of another shape are left out."""
    parts = F.split("value", r"\|", 3)
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s*\|\s*\d+\s*\|"))
    ids = [F.trim(parts[i]).cast("long") for i in range(2)]
    return rows.select(F.lit(field).alias("field"), ids[1].alias("rowid"), ids[0].alias("book_id"), ids[1].alias("item_id"), F.trim(parts[2]).alias("text"))


def from_jsonl(rows: DataFrame, book_id: int = 1) -> DataFrame:
    """Documents with a page and a title as items of both fields; the number in doc_id is their id."""
    ident = F.regexp_extract("doc_id", r"(\d+)", 1).cast("long")
    fields = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("text")) for name in ("page", "title")])
    each = rows.select(ident.alias("rowid"), F.explode(fields).alias("f"))
    return each.select("f.field", "rowid", F.lit(book_id).cast("long").alias("book_id"), F.col("rowid").alias("item_id"), "f.text").where("text is not null")


def table_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The tables documents (pages of books, a book for each source) and pages (titles) as docs."""
    docs = spread(spark.read.parquet(f"{folder}/documents.parquet"))
    page = docs.select(F.lit("page").alias("field"), F.col("doc_id").alias("rowid"), F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("book_id"), F.col("doc_id").alias("item_id"), "text")
    pages = spread(spark.read.parquet(f"{folder}/pages.parquet"))
    text = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    title = pages.select(F.lit("title").alias("field"), F.col("page_id").alias("rowid"), (F.col("page_id") % 10).alias("book_id"), F.col("page_id").alias("item_id"), text.alias("text"))
    return page.unionByName(title)
