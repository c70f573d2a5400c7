"""The functions of the SQL surface: `register_all` makes them callable from spark.sql under names ar_*.

Those that built-ins can express are SQL functions over them, so they stay in the JVM; the others are Arrow UDFs
over `analyzer`, `spans` and `syntax`. Null handling is that of each function: null in, null out, unless its
line says otherwise. A search reads an index, so it is no scalar function: Engine.execute_json does it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..plans import syntax
from ..sources.pieces import by_row
from ..sources.storage import ship
from . import spans
from .analyzer import analyze, analyzer
from .analyzer import _PREFIXES, _SUFFIXES
from .columns import _DIACRITICS, _DIGITS, _HAMZA, _LETTERS, _UPPER

SPANS = "array<struct<start:int,end:int>>"
SNIPPET = "struct<snippet:string,phrase_unique:int,phrase_hits:int,term_unique:int,term_hits:int,highlight_chars:int,start:int,length:int>"


def _dicts(found: list[spans.Span]) -> list[dict]:
    return [{"start": s, "end": e} for s, e in found]


class _Lazy:
    """A UDF that calls f for each row; made when it is first used, since it needs a session."""

    def __init__(self, f, kind: str):
        self.f, self.kind, self.made = f, kind, None

    def __call__(self, *columns: Column) -> Column:
        if self.made is None:
            self.made = _made(self.f, self.kind)
        return self.made(*columns)


def _made(f, kind: str):
    """f as an iterator UDF: of a batch it holds the results of a piece only."""
    return F.arrow_udf(by_row(f, to_arrow_type(DataType.fromDDL(kind))), kind)


def _list(x) -> list[str] | None:
    return None if x is None else [t or "" for t in x]


def _json_list(x: str | None) -> list[str] | None:
    if x is None:
        return None
    found = json.loads(x)
    if not isinstance(found, list) or not all(isinstance(t, str) for t in found):
        raise ValueError("invalid terms_json: expected JSON string array")
    return found


analyze_terms = _Lazy(lambda t: analyze(t), "array<string>")
analyze_positions = _Lazy(lambda t: [{"term": x.term, "position": x.position} for x in analyzer().tokens(t)], "array<struct<term:string,position:int>>")
normalized_spans = _Lazy(lambda t, term, n: _dicts(spans.normalized_spans(t, term, int(8 if n is None else n))), SPANS)
analyzed_spans = _Lazy(lambda t, terms, mode, n: _dicts(spans.analyzed_spans(t, _list(terms), mode, int(8 if n is None else n))), SPANS)
highlight_normalized = _Lazy(lambda t, terms, mode, a, b, n: spans.highlight_normalized(t, _list(terms), mode, a, b, int(n)), "string")
highlight_analyzed = _Lazy(lambda t, terms, mode, a, b, n, raw: spans.highlight_analyzed(t, _list(terms), mode, a, b, int(n), _list(raw)), "string")
build_snippet = _Lazy(lambda t, q: spans.build_snippet(t, q), SNIPPET)
render_snippet = _Lazy(lambda t, s, e, csv: spans.render_snippet(t, int(s or 0), int(e or 0), spans.parse_spans(csv, False)), "string")


# Query helpers, as JSON


def _json(x) -> str | None:
    return None if x is None else json.dumps(x, ensure_ascii=False)


def _phrase_term(q: str) -> dict | None:
    found = syntax.phrase_term_boolean(q)
    if found is None:
        return None
    op, left, right = found
    shape = "_".join("phrase" if s.phrase is not None else "term" for s in (left, right))
    sides = {f"{name}_{k}": v for name, s in (("left", left), ("right", right)) for k, v in vars(s).items()}
    return {"shape": shape, "op": op, **sides}


def _named(names: str, found: tuple | None) -> dict | None:
    return None if found is None else dict(zip(names.split(), found))


def _rank_boost(q: str, field: str) -> dict | None:
    if not q.strip():
        return None
    return _named("boost_factor ranking_query", syntax.rank_boost(q, field))


#: One query string each; null gives null, except where the third item gives what it gives.
QUERY_FUNCTIONS = {
    "ar_parse_query_ast_json": (lambda q: syntax.tree(syntax.parse(q)), '{"clauses": []}'),
    "ar_parse_scoped_token_json": (lambda t: _named("scope raw", syntax.scoped(t)), None),
    "ar_strip_boost_json": (lambda t: _named("base boost", syntax.strip_boost(t)), None),
    "ar_parse_fuzzy_token_json": (lambda t: _named("base edits", syntax.fuzzy(t)), None),
    "ar_parse_phrase_query_json": (lambda q: _named("phrase slop", syntax.phrase_query(q)), None),
    "ar_parse_single_phrase_clause_json": (lambda q: _named("scope phrase slop boost", syntax.single_phrase(q)), None),
    "ar_parse_phrase_term_boolean_json": (_phrase_term, None),
    "ar_parse_simple_boolean_json": (lambda q: _named("op left left_boost right right_boost", syntax.simple_boolean(q)), None),
    "ar_parse_top_level_group_boost_json": (lambda q: _named("inner boost", syntax.whole_group_boost(q)), None),
    "ar_parse_whole_scoped_group_json": (lambda q: _named("scope inner boost", syntax.whole_field_group(q)), None),
    "ar_extract_boosted_phrase_spans_json": (lambda q: [_named("scope phrase slop boost", x) for x in syntax.boosted_phrases(q)], "[]"),
    "ar_iter_query_ast_leaves_json": (lambda q: [{"occur": o, "kind": n.kind, "value": n.value} for n, o in syntax.leaves(q)], "[]"),
    "ar_extract_snippet_query_terms_json": (spans.query_terms, "[]"),
    "ar_extract_snippet_query_phrases_json": (spans.query_phrases, "[]"),
}
QUERY_FIELD_FUNCTIONS = {
    "ar_parse_boosted_token_clause_json": (syntax.boosted_clause, None),
    "ar_preprocess_rank_boost_json": (_rank_boost, None),
    "ar_extract_boosted_group_spans_json": (lambda q, f: [_named("inner boost", x) for x in syntax.boosted_groups(q, f)], "[]"),
}


def _sql(parameters: str, returns: str, body: str) -> tuple[str, str, str]:
    return parameters, returns, body


_BYTE4 = "CASE WHEN n < 0 THEN raise_error('lengths aren''t negative') WHEN n < 24 THEN n WHEN n - 24 < 8 THEN n ELSE 24 + (((n - 24) >> (length(bin(n - 24)) - 4)) & 7 | ((length(bin(n - 24)) - 3) << 3)) END"
_INT4 = "CASE WHEN n < 0 OR n > 255 THEN raise_error('a byte is from 0 to 255') WHEN n < 24 THEN n WHEN n - 24 < 8 THEN n ELSE 24 + ((((n - 24) & 7) | 8) << (((n - 24) >> 3) - 1)) END"
_DECODE = "CASE WHEN i < 24 THEN i WHEN i - 24 < 8 THEN i ELSE 24 + ((((i - 24) & 7) | 8) << (((i - 24) >> 3) - 1)) END"


def _inverse(length: str) -> str:
    norm = f"CAST(CAST(CAST(1.0 AS FLOAT) - b AS FLOAT) + CAST(CAST(b * CAST({length} AS FLOAT) AS FLOAT) / avgdl AS FLOAT) AS FLOAT)"
    under = f"CAST(k1 * {norm} AS FLOAT)"
    return f"CASE WHEN avgdl <= 0 OR {under} <= 0 THEN CAST(0 AS FLOAT) ELSE CAST(CAST(1.0 AS FLOAT) / {under} AS FLOAT) END"


def _text(x: str) -> str:
    """A string literal; backslashes and quotes are escaped."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _normal(x: str) -> str:
    """Each distinction by its flag, letter case last."""
    steps = (("diacritics", _DIACRITICS, ""), ("hamza", _HAMZA, "ا" * 3), ("letters", _LETTERS, "يه"), ("digits", _DIGITS, "0123456789" * 2), ("lower", _UPPER, _UPPER.lower()))
    for name, source, to in steps:
        x = f"translate({x}, CASE WHEN coalesce({name}, {int(name != 'lower')}) <> 0 THEN {_text(source)} ELSE '' END, {_text(to)})"
    return x


def _sensitive() -> str:
    """Whether the text has a character of a distinction that counts; false for null."""
    sets = (("diacritics", _DIACRITICS), ("hamza", _HAMZA), ("letters", _LETTERS), ("digits", _DIGITS + "0123456789"))
    found = " OR ".join(f"(coalesce({name}, 0) <> 0 AND t RLIKE {_text('[' + chars + ']')})" for name, chars in sets)
    return f"CAST(coalesce({found}, false) AS INT)"


def _stem_sql() -> str:
    """The light stem: the first prefix that fits, then each suffix."""
    cases = " ".join(f"WHEN startswith(w, {_text(p)}) AND length(w) >= {max(len(p) + 2, 4 if len(p) == 1 else 0)} THEN substring(w, {len(p) + 1})" for p in _PREFIXES)
    out = f"CASE {cases} ELSE w END"
    for suffix in _SUFFIXES:
        out = f"regexp_replace({out}, {_text(f'(?s)^(.{{2,}}){suffix}' + chr(92) + 'z')}, '$1')"
    return out


#: A pattern without wildcards is looked for as it is; others as a regular expression, their other characters taken literally.
_WILDCARD = r"CASE WHEN NOT p RLIKE '[*?]' THEN contains(t, p) ELSE t RLIKE replace(replace(regexp_replace(p, '([^A-Za-z0-9*?\\u0080-\\x{10FFFF}])', '\\\\$1'), '*', '.*'), '?', '.') END"

_VALID = r"filter(transform(split(coalesce(csv, ''), ';'), x -> CASE WHEN x RLIKE '^\\s*[+-]?[0-9]+:\\s*[+-]?[0-9]+:\\s*[+-]?[0-9]+\\z' THEN transform(split(x, ':'), v -> CAST(try_cast(trim(v) AS BIGINT) AS BIGINT)) END), v -> v IS NOT NULL AND size(filter(v, y -> y IS NULL OR y < -2147483648 OR y > 2147483647)) = 0 AND v[0] >= 0 AND v[1] > v[0])"
_RANKED = f"transform(array_sort(transform({_VALID}, v -> struct(v[2] AS p, v[0] - v[1] AS size, v[0] AS s, v[1] AS e))), x -> struct(x.s AS s, x.e AS e))"
_PICKED = f"aggregate({_RANKED}, CAST(array() AS ARRAY<STRUCT<s: BIGINT, e: BIGINT>>), (got, x) -> CASE WHEN exists(got, g -> x.e > g.s AND x.s < g.e) THEN got ELSE concat(got, array(x)) END)"

_BREAK = r"\\s`~!@#$%^&*()\\-_=+\\[{\\]}\\\\|;:\'\",<.>/?،؛«»…"
_CLAMPED = "named_struct('s', least(greatest(coalesce(start, 0), 0), length(t)), 'e', least(greatest(coalesce(stop, 0), 0), length(t)), 'n', greatest(coalesce(scan, 12), 0))"
_BACK = f"length(regexp_extract(substring(t, greatest(w.s - w.n, 0) + 1, least(w.s, w.n)), '(?s)[^{_BREAK}]*\\\\z', 0))"
_AHEAD = f"length(regexp_extract(substring(t, w.e + 1, w.n), '(?s)^[^{_BREAK}]*', 0))"
_WIDER = f"named_struct('s', w.s, 'e', w.e, 'l', CASE WHEN {_BACK} < least(w.s, w.n) THEN w.s - {_BACK} ELSE w.s END, 'r', CASE WHEN {_AHEAD} < least(length(t) - w.e, w.n) THEN w.e + {_AHEAD} ELSE w.e END)"
_WINDOW = (
    f"CASE WHEN coalesce(t, '') = '' THEN '{{\"start\": 0, \"end\": 0}}' ELSE element_at(transform(transform(array({_CLAMPED}), w -> {_WIDER}), "
    "w -> concat('{\"start\": ', CASE WHEN w.r > w.l THEN w.l ELSE w.s END, ', \"end\": ', CASE WHEN w.r > w.l THEN w.r ELSE greatest(w.e, w.s) END, '}')), 1) END"
)

#: SQL functions over built-ins: Catalyst inlines them.
SQL_FUNCTIONS = {
    "ar_normalize": _sql("t STRING, diacritics INT DEFAULT 1, hamza INT DEFAULT 1, letters INT DEFAULT 1, digits INT DEFAULT 1, lower INT DEFAULT 0, wildcards INT DEFAULT 0", "STRING", _normal("t")),
    "ar_stem": _sql("w STRING", "STRING", _stem_sql()),
    "ar_has_sensitive_forms": _sql("t STRING, diacritics INT, hamza INT, letters INT, digits INT", "INT", _sensitive()),
    "ar_wildcard_match": _sql("t STRING, p STRING", "INT", f"CAST({_WILDCARD} AS INT)"),
    "ar_select_non_overlapping_spans_csv": _sql("csv STRING", "STRING", f"array_join(transform(array_sort({_PICKED}), x -> concat(x.s, ':', x.e)), ';')"),
    "ar_snap_snippet_window_json": _sql("t STRING, start INT, stop INT, scan INT DEFAULT 12", "STRING", _WINDOW),
    "ar_levenshtein": _sql("a STRING, b STRING, k INT", "INT", "CASE WHEN k < 0 THEN 0 WHEN levenshtein(a, b) > k THEN k + 1 ELSE levenshtein(a, b) END"),
    "ar_int_to_byte4": _sql("n BIGINT", "INT", f"CAST({_BYTE4} AS INT)"),
    "ar_byte4_to_int": _sql("n INT", "BIGINT", f"CAST({_INT4} AS BIGINT)"),
    "ar_f32_mul": _sql("a DOUBLE, b DOUBLE", "FLOAT", "CAST(CAST(a AS FLOAT) * CAST(b AS FLOAT) AS FLOAT)"),
    "ar_f32_add": _sql("a DOUBLE, b DOUBLE", "FLOAT", "CAST(CAST(a AS FLOAT) + CAST(b AS FLOAT) AS FLOAT)"),
    "ar_lucene_idf": _sql("n FLOAT, df FLOAT", "FLOAT", "CASE WHEN n <= 0 OR df <= 0 THEN CAST(0 AS FLOAT) ELSE CAST(ln(1.0D + (CAST(n AS DOUBLE) - df + 0.5D) / (CAST(df AS DOUBLE) + 0.5D)) AS FLOAT) END"),
    "ar_norm_inverse_cache": _sql("k1 FLOAT, b FLOAT, avgdl FLOAT", "ARRAY<FLOAT>", f"transform(sequence(0L, 255L), i -> {_inverse(_DECODE)})"),
    "ar_lucene_term_score": _sql(
        "w FLOAT, tf FLOAT, len BIGINT, k1 FLOAT, b FLOAT, avgdl FLOAT",
        "FLOAT",
        "CASE WHEN w = 0 OR tf <= 0 OR k1 <= 0 OR avgdl <= 0 THEN CAST(0 AS FLOAT) ELSE CAST(w - CAST(w / CAST(CAST(1.0 AS FLOAT) + CAST(tf * element_at(ar_norm_inverse_cache(k1, b, avgdl), ar_int_to_byte4(greatest(len, 0L)) + 1) AS FLOAT) AS FLOAT) AS FLOAT) AS FLOAT) END",
    ),
}


def _blob(k1, b, avgdl) -> bytes | None:
    """The 256 values of the norm cache as bytes."""
    import numpy as np

    from .columns import norm_inverse_values

    return None if None in (k1, b, avgdl) else np.array(norm_inverse_values(avgdl, k1, b), "<f4").tobytes()


def _spans_json(found: list[spans.Span]) -> str:
    return _json(_dicts(found))


#: Functions of plain rows: name -> (function, SQL type).
ROW_FUNCTIONS = {
    "ar_analyze_json": (lambda t: _json(analyze(t)), "string"),
    "ar_analyze_positions_json": (lambda t: _json([{"term": x.term, "position": x.position} for x in analyzer().tokens(t)]), "string"),
    "ar_norm_inverse_cache_blob": (_blob, "binary"),
    "ar_find_all_normalized_match_spans_json": (lambda t, term, n=8: _spans_json(spans.normalized_spans(t, term, n)), "string"),
    "ar_find_all_analyzed_match_spans_json": (lambda t, terms, mode="any", n=8: _spans_json(spans.analyzed_spans(t, _json_list(terms), mode, n)), "string"),
    "ar_highlight_normalized_matches": (lambda t, terms, mode, a, b, n: spans.highlight_normalized(t, _json_list(terms), mode, a, b, n), "string"),
    "ar_highlight_analyzed_matches": (lambda t, terms, mode, a, b, n, raw=None: spans.highlight_analyzed(t, _json_list(terms), mode, a, b, n, _json_list(raw)), "string"),
    "ar_render_snippet_with_highlights": (lambda t, s, e, csv: spans.render_snippet(t, int(s or 0), int(e or 0), spans.parse_spans(csv, False)), "string"),
    "ar_build_field_snippet_json": (lambda t, q: _json(spans.build_snippet(t, q)), "string"),
}


def query_function(name: str):
    """A query helper as a row function with its own null rule."""
    f, on_null = (QUERY_FUNCTIONS | QUERY_FIELD_FUNCTIONS)[name]

    def one(q, *field):
        return on_null if q is None else _json(f(q, *field))

    return one


class Tokens:
    """The table function ar_tokens(text): a row for each token."""

    def eval(self, text: str):
        yield from (tuple(t) for t in analyzer().tokens(text))


TOKEN_ROW = "term: string, offset: int, position: int, start: int, end: int"


def register_all(spark: SparkSession) -> list[str]:
    """Register every function with the session; gives their names."""
    ship(spark)
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    for name, (f, kind) in ROW_FUNCTIONS.items():
        spark.udf.register(name, _made(f, kind))
    for name in QUERY_FUNCTIONS | QUERY_FIELD_FUNCTIONS:
        spark.udf.register(name, F.udf(query_function(name), "string", useArrow=True))
    spark.udtf.register("ar_tokens", F.udtf(Tokens, returnType=TOKEN_ROW))
    return [*SQL_FUNCTIONS, *ROW_FUNCTIONS, *QUERY_FUNCTIONS, *QUERY_FIELD_FUNCTIONS]


def tokens(text: Column) -> Column:
    return analyze_terms(text)
