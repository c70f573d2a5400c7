"""Match expressions over postings.

All postings that an expression names are scanned at once and grouped by item, whatever its shape: one shuffle on
rowid. Whether an item matches, and how often each phrase occurs in it, are then expressions over one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import near_places
from ..plans.compiler import And, Near, Not, Nothing, Or, Phrase
from .index import Index

KEYS = ("rowid", "book_id", "item_id")


@dataclass
class Counted:
    """A phrase of the expression: how often it counts in an item, whether the item holds it at all, and its term if it is just one."""

    times: Column
    present: Column
    term: str | None = None


class _Columns:
    """The aggregates that an expression's phrases need, each under a name of its own."""

    def __init__(self):
        self.wanted: dict[tuple[str, str, bool], str] = {}

    def name(self, what: str, term: str, prefix: bool = False) -> Column:
        return F.col(self.wanted.setdefault((what, term, prefix), f"_c{len(self.wanted)}"))

    @staticmethod
    def _is(term: str, prefix: bool) -> Column:
        return F.col("term").startswith(term) if prefix else F.col("term") == term

    def filter(self) -> Column:
        exact = sorted({t for _, t, prefix in self.wanted if not prefix})
        out = F.col("term").isin(exact) if exact else F.lit(False)
        for _, t, prefix in self.wanted:
            if prefix:
                out = out | self._is(t, True)
        return out

    def aggregates(self) -> list[Column]:
        out = []
        for (what, term, prefix), name in self.wanted.items():
            here = self._is(term, prefix)
            if what == "tf":
                out.append(F.coalesce(F.sum(F.when(here, F.col("tf"))), F.lit(0)).alias(name))
            else:
                out.append(F.flatten(F.collect_list(F.when(here, F.col("offsets")))).alias(name))
        return out


def _phrase(p: Phrase, c: _Columns) -> Column:
    """How often a phrase occurs."""
    if len(p.terms) == 1:
        return c.name("tf", p.terms[0], p.prefix)
    last = len(p.terms) - 1
    lists = [c.name("offsets", t, p.prefix and i == last) for i, t in enumerate(p.terms)]

    def goes_on(at: Column) -> Column:
        out = F.lit(True)
        for i, x in enumerate(lists[1:], 1):
            out = out & F.array_contains(x, at + i)
        return out

    return F.size(F.filter(lists[0], goes_on))


def _walk(node, c: _Columns) -> tuple[Column, list[Counted]]:
    """Whether an item matches, and the phrases that count if it does."""
    if isinstance(node, Phrase):
        n = _phrase(node, c)
        return n > 0, [Counted(n, n > 0, _one(node))]
    if isinstance(node, Near):
        # A member is one term as a rule; of one that became several, the first word's place counts.
        lists = [c.name("offsets", m.terms[0], m.prefix and len(m.terms) == 1) for m in node.members]
        sizes = [F.size(x) for x in near_places(lists, node.slop)]
        return sizes[0] > 0, [Counted(n, _phrase(m, c) > 0, _one(m)) for n, m in zip(sizes, node.members)]
    if isinstance(node, (And, Or)):
        found = [_walk(p, c) for p in node.parts]
        hit = found[0][0]
        for other, _ in found[1:]:
            hit = hit & other if isinstance(node, And) else hit | other
        return hit, [_gated(p, hit) if isinstance(node, And) else p for _, ps in found for p in ps]
    if isinstance(node, Not):
        kept, phrases = _walk(node.kept, c)
        gone, _ = _walk(node.gone, c)
        hit = kept & ~gone
        return hit, [_gated(p, hit) for p in phrases]
    if isinstance(node, Nothing):
        return F.lit(False), []
    raise TypeError(f"no match expression: {node!r}")


def _gated(p: Counted, hit: Column) -> Counted:
    return Counted(F.when(hit, p.times).otherwise(0), p.present, p.term)


def _one(p: Phrase) -> str | None:
    return p.terms[0] if len(p.terms) == 1 and not p.prefix else None


def _grouped(index: Index, field: str, node) -> tuple[DataFrame, Column, list[Counted]]:
    c = _Columns()
    hit, phrases = _walk(node, c)
    if not c.wanted:
        return index.postings(field).where(F.lit(False)).select(*KEYS), F.lit(False), []
    return index.postings(field).where(c.filter()).groupBy(*KEYS).agg(*c.aggregates()), hit, phrases


def matches(index: Index, field: str, node) -> DataFrame:
    """(rowid, book_id, item_id) of the items that match."""
    rows, hit, _ = _grouped(index, field, node)
    return rows.where(hit).select(*KEYS)


def flags(index: Index, field: str, nodes: list) -> DataFrame:
    """(rowid, book_id, item_id, f0, f1, ...): which of several expressions each item matches, by one scan; items that match none may be left out."""
    c = _Columns()
    found = [_walk(node, c)[0].alias(f"f{i}") for i, node in enumerate(nodes)]
    if not c.wanted:
        return index.postings(field).where(F.lit(False)).select(*KEYS, *found)
    return index.postings(field).where(c.filter()).groupBy(*KEYS).agg(*c.aggregates()).select(*KEYS, *found)


def _holding(index: Index, field: str, rows: DataFrame, phrases: list[Counted]) -> list[int]:
    """How many items hold each phrase: of single terms the lexicon knows it, the others are counted by one more scan."""
    terms = index.doc_freqs(field, [p.term for p in phrases if p.term is not None])
    rest = [i for i, p in enumerate(phrases) if p.term is None]
    counts = rows.agg(*[F.coalesce(F.sum(F.when(phrases[i].present, 1).otherwise(0)), F.lit(0)) for i in rest]).first() if rest else []
    counted = dict(zip(rest, counts))
    return [counted[i] if p.term is None else terms[p.term] for i, p in enumerate(phrases)]


def row_bm25(index: Index, field: str, node) -> DataFrame:
    """(rowid, book_id, item_id, score) by BM25 over items in double precision, summed over all phrases; lower is better."""
    rows, hit, phrases = _grouped(index, field, node)
    if not phrases:
        return rows.where(F.lit(False)).select(*KEYS, F.lit(0.0).alias("score"))
    stats = index.field_stats(field)
    holding = _holding(index, field, rows, phrases)
    k1, b = 1.2, 0.75
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("row_len") / F.lit(stats.row_avgdl))
    score = F.lit(0.0)
    for i, p in enumerate(phrases):
        n = float(holding[i])
        idf = F.greatest(F.log((F.lit(float(stats.item_count)) - n + 0.5) / F.lit(n + 0.5)), F.lit(1e-6))
        times = p.times.cast("double")
        score = score + idf * (times * (k1 + 1)) / (times + norm)
    return rows.where(hit).join(index.row_lengths(field), "rowid").select(*KEYS, (-score).alias("score"))
