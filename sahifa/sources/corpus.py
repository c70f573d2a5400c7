"""The canonical two-field corpus: maps that identify items, stores that hold their texts, and the docs made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ITEM = "source_deleted int, source_sha1 string, ingested_at timestamp"
PAGE_MAP_SCHEMA = f"rowid long, book_id long, page_id long, page_no int, {_ITEM}"
TITLE_MAP_SCHEMA = f"rowid long, book_id long, title_id long, title_level int, title_parent_id long, {_ITEM}"
PAGE_STORE_SCHEMA, TITLE_STORE_SCHEMA = "rowid long, body string", "rowid long, title string"
META_SCHEMA = "id int, schema_version int, created_at timestamp, updated_at timestamp"


def _docs(field: str, items: DataFrame, store: DataFrame, ident: str, text: str) -> DataFrame:
    joined = items.select("rowid", "book_id", F.col(ident).alias("item_id")).join(store.select("rowid", F.col(text).alias("text")), "rowid")
    return joined.select(F.lit(field).alias("field"), "rowid", "book_id", "item_id", "text")


def docs_of(page_map: DataFrame, page_store: DataFrame, title_map: DataFrame, title_store: DataFrame) -> DataFrame:
    """Both fields' items with their texts, for build_index. Deleted items stay in, as searches don't ask for that mark."""
    return _docs("page", page_map, page_store, "page_id", "body").unionByName(_docs("title", title_map, title_store, "title_id", "title"))


def search_views(page_map: DataFrame, title_map: DataFrame) -> None:
    """The maps as views without hashes and times: v_page_search_docs, v_title_search_docs."""
    for name, rows in (("v_page_search_docs", page_map), ("v_title_search_docs", title_map)):
        rows.drop("source_sha1", "ingested_at").createOrReplaceTempView(name)


def title_paths(title_map: DataFrame) -> DataFrame:
    """(rowid, path): each title's ids from its topmost ancestor down; a parent that isn't there, or is in the path already, ends it."""
    path = title_map.select("rowid", "book_id", F.array("title_id").alias("path"), F.col("title_parent_id").alias("up"))
    parents = title_map.select(F.col("book_id").alias("b"), F.col("title_id").alias("t"), F.col("title_parent_id").alias("next"))
    while path.where("up is not null").limit(1).count():
        joined = path.join(parents, (F.col("book_id") == F.col("b")) & (F.col("up") == F.col("t")) & ~F.array_contains("path", F.col("t")), "left")
        path = joined.select("rowid", "book_id", F.when(F.col("t").isNull(), F.col("path")).otherwise(F.concat(F.array("t"), "path")).alias("path"), F.col("next").alias("up"))
    return path.select("rowid", "path")
