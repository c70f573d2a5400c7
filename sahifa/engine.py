"""The engine: search, explain and compile on an index, and many queries at once."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import columns, udfs
from .functions.analyzer import analyze, analyzer
from .operators.index import Index
from .operators.match import flags
from .operators.rank import HIT, Ranker, search_field, top
from .operators.strict import strict_filter
from .plans import syntax
from .plans.compiler import NO_HIT_TEXT, PRESETS, Compiler, SearchOptions
from .plans.syntax import FIELDS, QueryError

COLUMNS = ("field", *HIT, "score")


@dataclass
class SearchResult:
    """The expression of each field, and the hits (field, book_id, item_id, score), best first."""

    compiled: dict[str, str]
    hits: DataFrame

    def rows(self) -> list[dict]:
        return [r.asDict() for r in self.hits.collect()]


class Engine:
    def __init__(self, index: Index, options: SearchOptions = SearchOptions()):
        self.index, self.options = index, options

    def _strict(self, hits: DataFrame, q: str, field: str, options: SearchOptions) -> DataFrame:
        if not options.forms.strict:
            return hits
        texts = self.index.docs(field).select(*HIT, "text")
        return hits.join(texts, list(HIT), "left").where(strict_filter(F.col("text"), q, field, options.forms)).drop("text")

    def _field(self, q: str, field: str, options: SearchOptions, limit: int) -> tuple[str, DataFrame]:
        over = options.strict_overfetch and options.forms.strict
        compiled, hits = search_field(self.index, field, q, options, None if over else limit)
        hits = self._strict(hits, q, field, options)
        if over:
            hits = top(hits, limit)
        return compiled.text, hits.select(F.lit(field).alias("field"), *HIT, "score")

    def _empty(self) -> DataFrame:
        return self.index.spark.createDataFrame([], "field string, book_id long, item_id long, score double")

    def search(self, q: str, field: str = "both", limit: int = 20, options: SearchOptions | None = None) -> SearchResult:
        """The best hits of a query in page, title or both."""
        options = options or self.options
        if not q.strip():
            raise QueryError("query is empty after parsing")
        if field not in (*FIELDS, "both"):
            raise QueryError(f"unsupported field selection: {field}")
        if limit < 1:
            raise QueryError("limit must be >= 1")
        fields = FIELDS if field == "both" else (field,)
        try:
            found = {f: self._field(q, f, options, limit) for f in fields}
        except QueryError:
            if not options.lenient:
                raise
            return SearchResult(dict.fromkeys(fields, NO_HIT_TEXT), self._empty())
        hits = found[fields[0]][1]
        for f in fields[1:]:
            hits = hits.unionByName(found[f][1])
        order = ("score", "field", *HIT) if field == "both" else ("score", *HIT)
        hits = hits.orderBy(*order).limit(limit)
        return SearchResult({f: text for f, (text, _) in found.items()}, hits)

    def execute_json(self, q: str, field: str = "both", limit: int = 20, options_json: str | None = None) -> str:
        """A search as one call: {compiled, hits, scores_are_f32}; options as JSON with SearchOptions' names."""
        given = json.loads(options_json) if options_json else {}
        result = self.search(q, field, limit, replace(self.options, **given))
        return json.dumps({"compiled": result.compiled, "hits": result.rows(), "scores_are_f32": True}, ensure_ascii=False)

    def compile(self, q: str, field: str = "both", options: SearchOptions | None = None) -> dict[str, str]:
        """The match expression of each field, as a search would run it."""
        options = options or self.options
        fields = FIELDS if field == "both" else (field,)
        try:
            return {f: Compiler(self.index, f, options).query(syntax.rank_boost(q, f)[1]).text for f in fields}
        except QueryError:
            if not options.lenient:
                raise
            return dict.fromkeys(fields, NO_HIT_TEXT)

    def snippets(self, result: SearchResult, q: str) -> DataFrame:
        """The hits with the snippet of their text; only the hits' texts are read into Python."""
        texts = self.index.table("docs").select("field", *HIT, "text")
        rows = result.hits.join(texts, ["field", *HIT], "left")
        return rows.withColumn("snippet", udfs.build_snippet(F.col("text"), F.lit(q))["snippet"]).drop("text").orderBy("score", "field", *HIT)

    def batch_terms(self, terms: dict[str, str], field: str = "page", limit: int = 20) -> DataFrame:
        """(query_id, book_id, item_id, score, rank) of many one-term queries: one scan of the postings, one top-k for each."""
        from pyspark.sql import Window

        analysed = {k: found[0] for k, t in terms.items() if len(found := analyze(t)) == 1}
        freq = self.index.doc_freqs(field, sorted(set(analysed.values())))
        stats = self.index.field_stats(field)
        known = [(k, t, freq[t]) for k, t in analysed.items() if freq[t]]
        # Sent to the postings, as it comes from the driver: a shuffle by term would take all of a term's postings to one task.
        wanted = self.index.spark.createDataFrame(known, "query_id string, term string, df long")
        ranker = Ranker(self.index, field)
        rows = self.index.postings(field).where(F.col("term").isin(sorted({t for _, t, _ in known}))).join(F.broadcast(wanted), "term")
        rows = rows.join(self.index.book_lengths(field), "book_id", "left")
        score = ranker._score(columns.idf(F.lit(stats.doc_count), F.col("df")), F.col("tf")).cast("double").alias("score")
        rows = rows.select("query_id", *HIT, score)
        best = Window.partitionBy("query_id").orderBy("score", *HIT)
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)

    def explain(self, q: str, field: str = "both", limit: int = 20, options: SearchOptions | None = None, assertions: dict | None = None) -> dict:
        """What a query compiles to, how many items each clause and expansion matches, and what strictness changes.

        assertions: {"relaxed" or "strict": {"min_hits", "max_hits", "must_include": ["book:item"]}, "cross":
        {"strict_at_most_relaxed", "counts_differ"}}; what fails is listed.
        """
        options = options or self.options
        result = self.search(q, field, limit, options)
        fields = FIELDS if field == "both" else (field,)
        clauses, expansions = [], []
        for f in fields:
            compiler = Compiler(self.index, f, options)
            leaves = [(leaf, occur, found) for leaf, occur in dict.fromkeys(syntax.leaves(q)) if (found := compiler._leaf(leaf)) is not None]
            # One scan counts all clauses and expansions.
            nodes = [found.node for *_, found in leaves] + [e.found.node for e in compiler.events]
            counts = flags(self.index, f, nodes).agg(*[F.count_if(f"f{i}").alias(f"n{i}") for i in range(len(nodes))]).first() if nodes else []
            clauses += [{"field": f, "occur": occur, "kind": leaf.kind, "clause": leaf.value, "compiled": found.text, "hits": n} for (leaf, occur, found), n in zip(leaves, counts)]
            expansions += [
                {"field": f, "kind": e.kind, "token": e.token, "normalized": e.normalized, "expansions": e.terms[:20], "expansion_count": len(e.terms), "compiled": e.found.text, "hits": n}
                for e, n in zip(compiler.events, counts[len(leaves) :])
            ]
        loose = replace(options, ignore_diacritics=True, ignore_hamza_forms=True, ignore_letter_forms=True, ignore_digit_forms=True)
        tight = replace(options, ignore_diacritics=False, ignore_hamza_forms=False, ignore_letter_forms=False, ignore_digit_forms=False)
        rows = {name: [f"{r['book_id']}:{r['item_id']}" for r in self.search(q, field, limit, o).rows()] for name, o in (("relaxed", loose), ("strict", tight))}
        out = {"compiled": result.compiled, "hits": result.hits.count(), "clauses": clauses, "expansions": expansions, "counts": {k: len(v) for k, v in rows.items()}, "plan": result.hits._jdf.queryExecution().toString()}
        return out if assertions is None else out | {"assertions": _asserted(rows, assertions)}

    def probe(self, text: str) -> list[dict]:
        """A text's tokens by the index's analyser."""
        return [t._asdict() for t in analyzer(self.index.options).tokens(text)]


def _asserted(rows: dict[str, list[str]], assertions: dict) -> dict:
    """What of the assertions on relaxed and strict hits doesn't hold."""
    out = {}
    for mode in ("relaxed", "strict"):
        wanted, found = assertions.get(mode, {}), rows[mode]
        failed = [f"expected at least {n} hits, got {len(found)}" for n in [wanted.get("min_hits")] if n is not None and len(found) < n]
        failed += [f"expected at most {n} hits, got {len(found)}" for n in [wanted.get("max_hits")] if n is not None and len(found) > n]
        failed += [f"missing expected item {k}" for k in wanted.get("must_include", ()) if k not in found]
        out[mode] = {"pass": not failed, "failures": failed}
    cross, relaxed, strict = assertions.get("cross", {}), len(rows["relaxed"]), len(rows["strict"])
    failed = [f"expected strict hits <= relaxed hits ({strict} > {relaxed})"] if cross.get("strict_at_most_relaxed") and strict > relaxed else []
    failed += [f"expected the counts to differ (both {strict})"] if cross.get("counts_differ") and strict == relaxed else []
    return out | {"cross": {"pass": not failed, "failures": failed}}


def result_json(result: SearchResult, q: str, field: str, options: SearchOptions) -> str:
    return json.dumps({"query": q, "field": field, "options": vars(options), "compiled": result.compiled, "hits": result.rows()}, ensure_ascii=False)


__all__ = ["COLUMNS", "PRESETS", "Engine", "SearchOptions", "SearchResult", "result_json"]
