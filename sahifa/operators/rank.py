"""Ranking one field: single-precision BM25 for the shapes that have it, row BM25 or a constant for the rest.

The better hit has the lower score; ties go by book and item. Every scorer gives all hits (book_id, item_id,
score); the limit comes last, as a top-k that needs no full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..functions.analyzer import SENTINEL, analyze, phrase_terms
from ..plans import syntax
from ..plans.compiler import Compiled, Compiler, SearchOptions
from ..plans.syntax import MUST_NOT
from .index import Index
from .match import flags, matches, row_bm25

HIT = ("book_id", "item_id")


def top(hits: DataFrame, limit: int | None) -> DataFrame:
    return hits if limit is None else hits.orderBy("score", *HIT).limit(limit)


def _none(index: Index, field: str) -> DataFrame:
    return index.postings(field).where(F.lit(False)).select(*HIT, F.lit(0.0).cast("float").alias("score"))


class Ranker:
    def __init__(self, index: Index, field: str):
        self.index, self.field = index, field
        self.stats = index.field_stats(field)

    def _score(self, weight: Column, tf: Column) -> Column:
        # Without a length (a null book), as if it were 0.
        norm = F.coalesce("norm", columns.norm_inverse(F.lit(0), self.stats.avgdl))
        return (-columns.weighted_score(weight, tf, norm)).cast("float")

    def _with_lengths(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.index.book_lengths(self.field), "book_id", "left")

    def term(self, term: str) -> DataFrame:
        n = self.index.doc_freqs(self.field, [term])[term]
        if not n or not self.stats.doc_count:
            return _none(self.index, self.field)
        rows = self.index.postings(self.field).where(F.col("term") == term).select(*HIT, "tf")
        return self._with_lengths(rows).select(*HIT, self._score(columns.idf(self.stats.doc_count, n), F.col("tf")).alias("score"))

    def two_terms(self, op: str, left: str, left_boost: float, right: str, right_boost: float) -> DataFrame:
        """Both terms in one scan, grouped by item."""
        freq = self.index.doc_freqs(self.field, [left, right])
        weight = {t: columns.idf(self.stats.doc_count, n) for t, n in freq.items()}
        rows = self.index.postings(self.field).where(F.col("term").isin(sorted(freq)))
        rows = rows.groupBy(*HIT).agg(F.max(F.when(F.col("term") == left, F.col("tf"))).alias("l"), F.max(F.when(F.col("term") == right, F.col("tf"))).alias("r"))
        if op == "AND":
            rows = rows.where("l is not null and r is not null")
        sides = [F.when(F.col(c).isNull(), F.lit(0.0).cast("float")).otherwise(columns.f32_mul(self._score(weight[t], F.col(c)), b)) for c, t, b in (("l", left, left_boost), ("r", right, right_boost))]
        return self._with_lengths(rows).select(*HIT, columns.f32_add(*sides).alias("score"))

    def phrase(self, terms: list[str], positions: list[int], slop: int) -> DataFrame:
        """A phrase of several terms: offsets find the candidates, positions say how often it occurs."""
        freq = self.index.doc_freqs(self.field, terms)
        if not self.stats.doc_count or not all(freq.values()) or "" in terms:
            return _none(self.index, self.field)
        weight = F.lit(0.0).cast("float")
        for t in terms:
            weight = columns.f32_add(weight, columns.idf(self.stats.doc_count, freq[t]))
        unique = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        rows = self.index.postings(self.field).where(F.col("term").isin(sorted(unique)))
        places = [F.first(F.when(F.col("term") == t, F.col(kind)), ignorenulls=True).alias(f"{kind}{i}") for t, i in unique.items() for kind in ("offsets", "positions")]
        rows = rows.groupBy(*HIT).agg(F.count("*").alias("held"), *places).where(F.col("held") == len(unique))
        offsets, logical = ([F.col(f"{kind}{unique[t]}") for t in terms] for kind in ("offsets", "positions"))
        if len(terms) == 2 and slop == 0 and positions == [0, 1]:
            candidate = F.exists(offsets[0], lambda x: F.array_contains(offsets[1], x + 1))
        else:
            candidate = columns.phrase_frequency(offsets, positions, slop) > 0
        rows = rows.where(candidate).select(*HIT, columns.phrase_frequency(logical, positions, slop).alias("tf")).where("tf > 0")
        return self._with_lengths(rows).select(*HIT, self._score(weight, F.col("tf")).alias("score"))

    def phrase_text(self, text: str, slop: int) -> DataFrame:
        terms, positions = phrase_terms(text)
        if not terms:
            return _none(self.index, self.field)
        return self.term(terms[0]) if len(terms) == 1 else self.phrase(terms, positions, slop)

    def _simple_boolean(self, q: str) -> DataFrame | None:
        found = syntax.simple_boolean(q)
        if found is None:
            return None
        op, left, left_boost, right, right_boost = found
        sides = [(terms[0], b) for terms, b in ((analyze(left), left_boost), (analyze(right), right_boost)) if len(terms) == 1]
        if not sides:
            return _none(self.index, self.field)
        if len(sides) == 1:
            return boosted(self.term(sides[0][0]), sides[0][1])
        return self.two_terms(op, *sides[0], *sides[1])

    def _side(self, side: syntax.Side) -> DataFrame | None:
        if side.scope not in (None, self.field):
            return _none(self.index, self.field)
        if side.phrase is not None:
            return self.phrase_text(side.phrase, side.slop)
        terms = analyze(side.term)
        return self.term(terms[0]) if len(terms) == 1 else None

    def _phrase_term_boolean(self, q: str) -> DataFrame | None:
        found = syntax.phrase_term_boolean(q)
        if found is None:
            return None
        op, left, right = found
        sides = [self._side(left), self._side(right)]
        if None in sides:
            return None
        l, r = (s.select(*HIT, columns.f32_mul(F.col("score"), x.boost).alias(name)) for s, x, name in zip(sides, (left, right), "lr"))
        zero = F.lit(0.0).cast("float")
        joined = l.join(r, list(HIT), "inner" if op == "AND" else "full")
        return joined.select(*HIT, columns.f32_add(F.coalesce("l", zero), F.coalesce("r", zero)).alias("score"))

    def lucene(self, q: str) -> DataFrame | None:
        """The hits of a query of a known shape, or None."""
        simple = q.strip()
        if syntax.SIMPLE.fullmatch(simple) and len(terms := analyze(simple)) == 1:
            return self.term(terms[0])
        for scorer in (self._phrase_term_boolean, self._simple_boolean):
            hits = scorer(q)
            if hits is not None:
                return hits
        if phrase := syntax.phrase_query(q):
            return self.phrase_text(*phrase)
        return None

    def is_one_pattern(self, q: str) -> bool:
        """Whether the query is one wildcard token, with or without + or -."""
        tokens = syntax.split(q)
        if len(tokens) == 2 and tokens[0] in (("token", "+"), ("token", "-")):
            tokens = tokens[1:]
        if len(tokens) != 1 or tokens[0][0] != "token":
            return False
        token = tokens[0][1]
        token = token[1:] if token[:1] in ("+", "-") else token
        if not token or token.upper() in syntax.OPERATORS:
            return False
        scope, raw = syntax.scoped(token)
        return scope in (None, self.field) and syntax.has_wildcard(syntax.strip_boost(raw)[0])


def boosted(hits: DataFrame, factor: float) -> DataFrame:
    return hits if syntax.trivial(factor) else hits.withColumn("score", columns.f32_mul(F.col("score"), factor))


def boosted_parts(compiler: Compiler, q: str) -> list[tuple[Compiled, float]]:
    """Every boosted clause of a query as an expression: terms, patterns and fuzzy terms, phrases, groups."""
    terms, patterns = [], []

    def tokens(inner: str) -> None:
        for leaf, occur in syntax.leaves(inner):
            if group := syntax.field_group(leaf):
                if group[0] == compiler.field:
                    tokens(group[1])
            elif leaf.kind == "token" and occur != MUST_NOT and leaf.value.upper() not in syntax.OPERATORS:
                clause = syntax.boosted_clause(leaf.value, compiler.field)
                if clause is None:
                    continue
                if clause["has_wildcard"] or clause["is_fuzzy"]:
                    scope = "" if clause["scope"] is None else clause["scope"] + ":"
                    if (found := compiler.token(scope + clause["raw"])) is not None:
                        patterns.append((found, clause["boost"]))
                elif len(found := analyze(clause["raw"])) == 1 and found[0] != SENTINEL:
                    terms.append((Compiled(found[0], compiler.term_node(found[0])), clause["boost"]))

    def phrases(inner: str) -> list[tuple[Compiled, float]]:
        rest, groups = syntax.cut_field_groups(inner, compiler.field)
        out = [(compiler.phrase(text, slop), boost) for scope, text, slop, boost in syntax.boosted_phrases(rest) if scope in (None, compiler.field)]
        return out + [x for g in groups for x in phrases(g)]

    tokens(q)
    groups = [(compiler.query(inner), boost) for inner, boost in syntax.boosted_groups(q, compiler.field)]
    return terms + patterns + phrases(q) + groups


def with_clause_boosts(index: Index, compiler: Compiler, hits: DataFrame, q: str) -> DataFrame:
    """hits with their scores times the boosts of the clauses that each one matches."""
    parts = boosted_parts(compiler, q)
    if not parts:
        return hits
    factor = F.lit(1.0).cast("float")
    for i, (_, boost) in enumerate(parts):
        factor = F.when(F.col(f"_b{i}"), columns.f32_mul(factor, boost)).otherwise(factor)
    # One scan of the postings says of all clauses which items they match.
    found = flags(index, compiler.field, [part.node for part, _ in parts])
    hits = hits.join(found.select(*HIT, *[F.col(f"f{i}").alias(f"_b{i}") for i in range(len(parts))]), list(HIT), "left")
    score = F.when(F.abs(factor - 1) >= 1e-12, columns.f32_mul(F.col("score"), factor).cast("double")).otherwise(F.col("score").cast("double"))
    return hits.select(*HIT, score.alias("score"))


def search_field(index: Index, field: str, q: str, options: SearchOptions, limit: int | None) -> tuple[Compiled, DataFrame]:
    """The expression of a query in a field, and its hits (book_id, item_id, score); the limit comes before the boosts."""
    factor, ranked = syntax.rank_boost(q, field)
    compiler = Compiler(index, field, options)
    compiled = compiler.query(ranked)
    ranker = Ranker(index, field)
    hits = ranker.lucene(ranked)
    if hits is None and ranker.is_one_pattern(ranked):
        hits = matches(index, field, compiled.node).select(*HIT, F.lit(-1.0).cast("float").alias("score"))
    if hits is not None:
        return compiled, boosted(top(hits, limit), factor).withColumn("score", F.col("score").cast("double"))
    hits = boosted(top(row_bm25(index, field, compiled.node).select(*HIT, "score"), limit), factor)
    return compiled, with_clause_boosts(index, compiler, hits, ranked).withColumn("score", F.col("score").cast("double"))
