"""Operator 1: URL filter by a cascade of Bloom filters, exact over the corpus's keys.

The universe is all distinct URL keys of the corpus. The first filter encodes the listed keys, the second those
unlisted keys of the universe that the first takes for listed, the third the listed ones that the second takes
for unlisted, and so on until a filter errs on no key. A key of the universe is listed if the first filter that
doesn't know it is at an even place (counted from one), which is exact: no key is joined with the list.

Keys are split into shards by their hash, as many as keep a shard's keys to SHARD_KEYS, and each shard's cascade
is built by one task. Pages are asked where they lie, by filters sent to every executor, while these have SENT_BYTES
at most in all; beyond that the pages are dealt out by their keys' shards, each shard's over SALTS tasks' shares, so
that a URL that many pages have is no task's alone, and a task reads one shard's filters at a time. Either way a
page is decided by probing filters, and never by a join.

A key is the URL in lower case without scheme, leading "www.", query, fragment and closing slashes. A null URL
has no key and is never listed; an empty one has the empty key, which can be listed. Null and repeated keys in
the list count once or not at all. Rows with the same URL are decided alike. An empty list rejects nothing, an empty
table of pages gives an empty one. Columns of any name stay as they are: the operator's own get names that pages lacks.
"""

from __future__ import annotations

from typing import Iterator, Tuple  # noqa: UP035 - pandas UDFs know only these

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARD_KEYS = 2_000_000
SENT_BYTES = 64 << 20
SALTS = 64
FIRST_BITS, LATER_BITS = 8, 2
MOST_LEVELS = 200
#: A page with a title like this has its URL listed, in the registered query.
JUNK_TITLE = r"<title>[^<]*(###|\*\*\*|%%%)"


def url_key(url: F.Column) -> F.Column:
    bare = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"/+$", "")


def hashes(key: F.Column) -> list[F.Column]:
    """Two 64-bit hashes; keys that agree in both are taken for one."""
    return [F.xxhash64(key).alias("h0"), F.xxhash64(F.lit("second"), key).alias("h1")]


def _probes(h0: np.ndarray, h1: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    salt = common.mix64(np.array([level], np.uint64))[0]
    a, b = common.mix64(h0 ^ salt), common.mix64(h1 + salt) | np.uint64(1)
    return (a[:, None] + np.arange(k, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def _size(n: int, level: int) -> tuple[int, int]:
    """Bits and probes of a level's filter of n keys."""
    per = FIRST_BITS if level == 1 else LATER_BITS
    return max(64, -(-n * per // 8) * 8), max(1, round(per * 0.69))


def build_cascade(h0: np.ndarray, h1: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """The levels (bits, probes, filter) that tell the listed keys from the others."""
    inside = np.flatnonzero(listed)
    outside = np.flatnonzero(~listed)
    levels: list[tuple[int, int, bytes]] = []
    while len(inside):
        level = len(levels) + 1
        if level > MOST_LEVELS:
            raise ValueError("a listed key and an unlisted one have the same hashes")
        bits, k = _size(len(inside), level)
        filled = np.zeros(bits, bool)
        filled[_probes(h0[inside], h1[inside], level, k, bits)] = True
        levels.append((bits, k, np.packbits(filled).tobytes()))
        wrong = outside[filled[_probes(h0[outside], h1[outside], level, k, bits)].all(1)]
        inside, outside = wrong, inside
    return levels


def ask_cascade(levels: list[tuple[int, int, bytes]], h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """Whether each key is listed; a filter's bits are looked up where they are packed."""
    out = np.zeros(len(h0), bool)
    left = np.arange(len(h0))
    for level, (bits, k, data) in enumerate(levels, 1):
        if not len(left):
            return out
        packed = np.frombuffer(data, np.uint8)
        at = _probes(h0[left], h1[left], level, k, bits).astype(np.int64)
        known = ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
        out[left[~known]] = level % 2 == 0
        left = left[known]
    out[left] = len(levels) % 2 == 1
    return out


def shard_of(h0: F.Column, shards: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("shard"), h0), F.lit(shards)).cast("int")


class Cascade:
    """A table of filters (shard, level, bits, probes, data), split into shards, and where it lies."""

    def __init__(self, table: DataFrame, shards: int, path: str):
        self.table, self.shards, self.path = table, shards, path

    def bytes(self) -> int:
        return int(self.table.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0])


def cascade(universe: DataFrame, listed: DataFrame, scratch: common.Scratch, shard_keys: int = SHARD_KEYS) -> Cascade:
    """The cascade of listed(key) over universe(key)."""
    spark = universe.sparkSession
    common.ship(spark)
    rows = universe.where("key is not null").select(*hashes(F.col("key")), F.lit(False).alias("listed"))
    rows = rows.union(listed.where("key is not null").select(*hashes(F.col("key")), F.lit(True)))
    keys = scratch.write(rows.groupBy("h0", "h1").agg(F.max("listed").alias("listed")), "keys")
    shards = max(1, -(-keys.count() // shard_keys))

    def build(key, t):
        h0, h1 = (t.column(c).to_numpy().view(np.uint64) for c in ("h0", "h1"))
        levels = build_cascade(h0, h1, t.column("listed").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()] * len(levels), pa.int32()), "level": pa.array(range(1, len(levels) + 1), pa.int32()), "bits": pa.array([x[0] for x in levels], pa.int64()), "probes": pa.array([x[1] for x in levels], pa.int32()), "data": pa.array([x[2] for x in levels], pa.binary())})

    marked = keys.select(shard_of(F.col("h0"), shards).alias("shard"), "h0", "h1", "listed")
    made = marked.groupBy("shard").applyInArrow(build, "shard int, level int, bits long, probes int, data binary")
    return Cascade(scratch.write(made, "cascade"), shards, scratch.path("cascade"))


def _levels(rows) -> dict[int, list[tuple[int, int, bytes]]]:
    out: dict[int, list[tuple[int, int, bytes]]] = {}
    for shard, _, bits, probes, data in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(shard, []).append((bits, probes, bytes(data)))
    return out


def read_levels(path: str, shard: int) -> list[tuple[int, int, bytes]]:
    """One shard's filters, from where they lie."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    at, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    found = ds.dataset(root, filesystem=at, format="parquet").to_table(filter=ds.field("shard") == shard)
    return _levels(zip(*(found.column(c).to_pylist() for c in ("shard", "level", "bits", "probes", "data")))).get(shard, [])


def unlisted(pages: DataFrame, found: Cascade, url: str = "url", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows of pages whose URL isn't listed; every key must be of the cascade's universe."""
    spark, path = pages.sparkSession, found.path
    key = url_key(F.col(f"`{url}`"))
    h0, h1 = hashes(key)
    shard = shard_of(h0, found.shards)
    sent = spark.sparkContext.broadcast(_levels(found.table.collect())) if found.bytes() <= sent_bytes else None

    @F.pandas_udf("boolean")
    def is_listed(batches: Iterator[Tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held, kept = -1, []
        for h0, h1, shard in batches:
            a, b = h0.to_numpy().view(np.uint64), h1.to_numpy().view(np.uint64)
            of, out = shard.to_numpy(), np.zeros(len(h0), bool)
            for s in np.unique(of):
                if sent is None and s != held:
                    held, kept = s, read_levels(path, int(s))
                at = np.flatnonzero(of == s)
                out[at] = ask_cascade(kept if sent is None else sent.value.get(int(s), []), a[at], b[at])
            yield pd.Series(out)

    if sent is not None:
        return pages.where(key.isNull() | ~is_listed(h0, h1, shard))
    # Dealt out by shard and a part of the whole row's hash, and sorted: a task has one shard's rows after another's.
    names = common.fresh(pages, "shard", "part")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]), F.lit(SALTS))
    dealt = pages.withColumns({names[0]: F.when(key.isNull(), -1).otherwise(shard), names[1]: part})
    dealt = dealt.repartition(common.partitions(spark), *names).sortWithinPartitions(names[0])
    return dealt.where((F.col(names[0]) < 0) | ~is_listed(h0, h1, F.col(names[0]))).drop(*names)


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "url", shard_keys: int = SHARD_KEYS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows of pages whose URL's key isn't that of a URL in listed."""
    scratch = common.Scratch(pages.sparkSession, "urls")
    universe = pages.select(url_key(F.col(f"`{url}`")).alias("key"))
    keys = listed.select(url_key(F.col(f"`{listed_url}`")).alias("key"))
    return unlisted(pages, cascade(universe, keys, scratch, shard_keys), url, sent_bytes)


def query(spark, sf_dir: str) -> DataFrame:
    """Every page whose URL isn't that of a page with a junk title."""
    pages = common.table(spark, sf_dir, "pages")
    listed = pages.where(F.col("html").rlike(JUNK_TITLE)).select("url")
    return filter_urls(pages.select("page_id", "url"), listed).select("page_id", "url")


ORACLE_SQL = r"""
WITH keyed AS (
  SELECT page_id, url, html,
         regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://(www\.)?', ''), '[?#].*$', ''), '/+$', '') AS key
  FROM pages)
SELECT page_id, url FROM keyed
WHERE key IS NULL OR key NOT IN (SELECT key FROM keyed WHERE key IS NOT NULL AND regexp_matches(html, '<title>[^<]*(###|\*\*\*|%%%)'))
"""
