"""The registered queries, over whole tables and the texts as they are, and DuckDB SQL for those that SQL can express.

Three indexes are built, once in a session: `page` of the documents and `title` of the pages; and the documents in
Arabic letters, a letter for each Latin one (`arabic_` queries), so that stop words, spelling and stems come into
play. Hits and spans aren't limited, except where the top k is what is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import analyzer, columns, udfs
from .functions.columns import Forms
from .operators.index import Index, build_index, tokens_of
from .operators.match import matches, row_bm25
from .operators.rank import Ranker, search_field
from .operators.strict import strict_filter
from .plans.compiler import Compiler, SearchOptions
from .sources.readers import table_documents
from .sources.sinks import latest, upsert
from .sources.storage import fresh_path, spread
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_indexes: dict[tuple[str, str, str], Index] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters such that frequent words become stop words, words begin and end with affixes, and spellings vary.
_ARABIC = "وحتطداإقفزكعميلرًشنثأسةصىخ"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/documents.parquet"))


def in_arabic(text: Column) -> Column:
    """The text's words in Arabic letters, with one space for all else."""
    return F.translate(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z]+", " "), _LOWER, _ARABIC)


def arabic_documents(spark: SparkSession, folder: str) -> DataFrame:
    book = F.regexp_extract("source", "[0-9]+", 0).cast("long")
    return documents(spark, folder).select(F.lit("page").alias("field"), F.col("doc_id").alias("rowid"), book.alias("book_id"), F.col("doc_id").alias("item_id"), in_arabic(F.col("text")).alias("text"))


_SOURCES: dict[str, Query] = {"corpus": table_documents, "arabic": arabic_documents}


def corpus_index(spark: SparkSession, folder: str, kind: str = "corpus") -> Index:
    """The index of a folder's documents and page titles, or of its documents in Arabic letters."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _indexes:
        _indexes[key] = build_index(_SOURCES[kind](spark, folder), fresh_path(spark, "index"))
    return _indexes[key]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _hits(df: DataFrame) -> DataFrame:
    return df.select("book_id", "item_id", F.round(F.col("score").cast("double"), 6).alias("score"))


# SQL pieces


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ranges(kinds: set[int]) -> str:
    """The code points of these classes, for the inside of a character set."""
    found = [cp for cp in range(0x110000) if analyzer.CLASS[cp] in kinds and not 0xD800 <= cp <= 0xDFFF]
    starts = [cp for cp, before in zip(found, [-2, *found]) if cp != before + 1]
    ends = [cp for cp, after in zip(found, [*found[1:], -2]) if cp + 1 != after]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


def _token_pattern() -> str:
    """One token of a text without Arabic: the analyser's joining rules as one regular expression without lookahead."""
    other = _ranges({analyzer.OTHER})
    letter, digit, any_ = "[A-Za-z_]", "[0-9]", f"[0-9A-Za-z_{other}]"
    rest = f"[{other}]{any_}*"
    after_letter, after_digit = f"(?:['’:.]?{letter})", f"(?:['’:.;,]?{digit})"
    digits = f"['’]?{digit}{after_digit}*"
    to_letter = f"(?:{letter}|{digit}{after_digit}*['’]?{letter})(?:{after_letter}|{digits}['’]?{letter})*"
    return f"(?:{to_letter}(?:{digits}(?:{rest})?|\\.?{rest})?|{digit}{after_digit}*(?:{rest})?|{rest})"


TOKEN = _sql_text(_token_pattern())


def _fold(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    """The terms of a text, in order."""
    return f"[{_fold('x')} for x in regexp_extract_all({text}, {TOKEN}) if replace(x, '_', '') <> '']"


ITEMS = f"""
items AS (SELECT doc_id AS rowid, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS book_id, doc_id AS item_id, {_words("text")} AS words FROM documents)"""
TITLES = f"""
items AS (SELECT page_id AS rowid, page_id % 10 AS book_id, page_id AS item_id, {_words("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS words FROM pages)"""
_LENGTHS = """,
blen AS (SELECT book_id, count(*) AS len FROM tok GROUP BY 1),
st AS (SELECT count(*) AS n, CAST(CAST(sum(len) AS DOUBLE) / count(*) AS REAL) AS avgdl FROM blen)"""
TOKENS = (
    """,
tok AS (SELECT rowid, book_id, item_id, unnest(words) AS term, unnest(range(len(words))) AS off FROM items)"""
    + _LENGTHS
)
PAGE = "WITH" + ITEMS + TOKENS

_MARKS = "[ـً-ٟۖ-ۭ]"


def _arabic_sql(text: str) -> str:
    return f"translate(regexp_replace({_fold(text)}, '[^a-z]+', ' ', 'g'), '{_LOWER}', '{_ARABIC}')"


def _normal_sql(x: str) -> str:
    return f"translate(regexp_replace({x}, '{_MARKS}', '', 'g'), 'آأإىة', 'ااايه')"


def _stem_sql(x: str) -> str:
    """The light stem of a normalised word, affix by affix."""
    cases = "".join(f" WHEN starts_with({x}, '{p}') AND length({x}) >= {max(len(p) + 2, 4 if len(p) == 1 else 0)} THEN substr({x}, {len(p) + 1})" for p in ("ال", "وال", "بال", "كال", "فال", "لل", "و"))
    out = f"(CASE{cases} ELSE {x} END)"
    for suffix in ("ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي"):
        out = f"regexp_replace({out}, '^(.{{2,}}){suffix}$', '\\1')"
    return out


_STOPPED = ", ".join(map(_sql_text, sorted(analyzer.STOP_WORDS)))
RAW = f"""
raws AS (SELECT doc_id AS rowid, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS book_id, doc_id AS item_id,
  [ltrim(x, 'ً') for x in string_split({_arabic_sql("text")}, ' ') if ltrim(x, 'ً') <> ''] AS words FROM documents)"""
ARABIC = (
    "WITH"
    + RAW
    + f""",
split AS (SELECT rowid, book_id, item_id, unnest(words) AS raw, unnest(range(len(words))) AS pos FROM raws),
forms AS (SELECT raw, {_normal_sql("raw")} AS normal FROM (SELECT DISTINCT raw FROM split WHERE raw NOT IN ({_STOPPED}))),
terms AS (SELECT raw, {_stem_sql("normal")} AS term FROM forms),
tok AS (SELECT rowid, book_id, item_id, term, pos, row_number() OVER (PARTITION BY rowid ORDER BY pos) - 1 AS off FROM split JOIN terms USING (raw))"""
    + _LENGTHS
)


def _arabic(latin: str) -> str:
    return latin.translate(str.maketrans(_LOWER, _ARABIC))


def _term_of(latin: str) -> str:
    found = analyzer.analyze(_arabic(latin))
    return found[0]


def _real(x) -> str:
    return f"CAST({x} AS REAL)"


def _idf(n: str, df: str) -> str:
    return _real(f"ln(1.0 + (CAST({n} AS DOUBLE) - {df} + 0.5) / ({df} + 0.5))")


def _quantised(n: str) -> str:
    return f"CASE WHEN {n} < 32 THEN {n} ELSE 24 + ((({n} - 24) >> (length(bin({n} - 24)) - 4)) << (length(bin({n} - 24)) - 4)) END"


def _score(weight: str, tf: str) -> str:
    norm = f"({_real(1)} - {_real(0.75)}) + {_real(0.75)} * {_real(_quantised('len'))} / avgdl"
    return f"-({weight} - {weight} / ({_real(1)} + {_real(tf)} * ({_real(1)} / ({_real(1.2)} * ({norm})))))"


def _term(name: str, term: str) -> str:
    """A table of a term's scores."""
    return f""",
{name}_df AS (SELECT count(DISTINCT rowid) AS df FROM tok WHERE term = '{term}'),
{name} AS (SELECT t.book_id, t.item_id, {_score(_idf("n", "df"), "tf")} AS score
  FROM (SELECT book_id, item_id, count(*) AS tf FROM tok WHERE term = '{term}' GROUP BY 1, 2) t JOIN blen USING (book_id), st, {name}_df)"""


def _phrase(name: str, terms: list[str], slop: int, at: str = "off", gaps: list[int] | None = None) -> str:
    """A table of a phrase's scores."""
    gaps = gaps or list(range(len(terms)))
    weight = " + ".join(_idf("n", f"df{i}") for i in range(len(terms)))
    joins = "".join(f" JOIN tok t{i} ON t{i}.rowid = t0.rowid AND t{i}.term = '{t}' AND t{i}.{at} > t{i - 1}.{at} AND t{i}.{at} - t0.{at} <= {gaps[i] + slop}" for i, t in enumerate(terms) if i)
    dfs = ", ".join(f"(SELECT count(DISTINCT rowid) FROM tok WHERE term = '{t}') AS df{i}" for i, t in enumerate(terms))
    return f""",
{name}_df AS (SELECT {dfs}),
{name} AS (SELECT t.book_id, t.item_id, {_score(f"({weight})", "tf")} AS score
  FROM (SELECT t0.book_id, t0.item_id, count(*) AS tf FROM tok t0{joins} WHERE t0.term = '{terms[0]}' GROUP BY 1, 2) t JOIN blen USING (book_id), st, {name}_df)"""


_ROUNDED = "round(CAST(score AS DOUBLE), 6) AS score"


def _merged(join: str, left: str, right: str, a: float = 1, b: float = 1) -> str:
    score = f"coalesce({left}.score, {_real(0)}) * {_real(a)} + coalesce({right}.score, {_real(0)}) * {_real(b)}"
    return f"SELECT book_id, item_id, round(CAST({score} AS DOUBLE), 6) AS score FROM {left} {join} JOIN {right} USING (book_id, item_id)"


# Index tables


@query("tokens_count", PAGE + " SELECT rowid, book_id, count(*) AS tokens FROM tok GROUP BY 1, 2")
def tokens_count(spark, folder):
    return corpus_index(spark, folder).table("row_lengths").where("field = 'page'").select("rowid", "book_id", F.col("len").alias("tokens"))


@query("vocabulary", PAGE + " SELECT term, count(DISTINCT rowid) AS doc, count(*) AS cnt FROM tok GROUP BY 1")
def vocabulary(spark, folder):
    return corpus_index(spark, folder).vocab("page").select("term", "doc", "cnt")


@query("vocabulary_top", PAGE + " SELECT term, count(DISTINCT rowid) AS doc, count(*) AS cnt FROM tok GROUP BY 1 ORDER BY cnt DESC, term LIMIT 50")
def vocabulary_top(spark, folder):
    return vocabulary(spark, folder).orderBy(F.desc("cnt"), "term").limit(50)


@query("postings", PAGE + " SELECT term, rowid, count(*) AS tf, min(off) AS first_offset, max(off) AS last_offset, CAST(sum(off) AS BIGINT) AS offsets FROM tok GROUP BY 1, 2")
def postings(spark, folder):
    rows = corpus_index(spark, folder).postings("page")
    total = F.aggregate("offsets", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("term", "rowid", F.col("tf").cast("long").alias("tf"), F.array_min("offsets").cast("long").alias("first_offset"), F.array_max("offsets").cast("long").alias("last_offset"), total.alias("offsets"))


@query("book_lengths", PAGE + " SELECT book_id, len FROM blen")
def book_lengths(spark, folder):
    return corpus_index(spark, folder).book_lengths("page").select("book_id", F.col("book_len").alias("len"))


@query("field_stats", PAGE + " SELECT 'page' AS field, n AS doc_count, (SELECT count(*) FROM documents) AS item_count, (SELECT count(*) FROM tok) AS tokens FROM st")
def field_stats(spark, folder):
    return corpus_index(spark, folder).table("stats").where("field = 'page'").select("field", "doc_count", "item_count", "tokens")


_NONE = "[^0-9A-Za-z_" + _ranges({analyzer.OTHER}) + "]*$"


@query("analyze_full", PAGE + f", ends AS (SELECT doc_id AS rowid, length(regexp_replace(text, '{_NONE}', '')) AS last_end FROM documents) SELECT rowid, count(*) AS tokens, CAST(max(off) AS INTEGER) AS last_position, CAST(any_value(last_end) AS INTEGER) AS last_end, CAST(sum(length(term)) AS BIGINT) AS characters FROM tok JOIN ends USING (rowid) GROUP BY 1")
def analyze_full(spark, folder):
    """Tokens of each document: how many, where they end, and how long their terms are."""
    docs = table_documents(spark, folder).where("field = 'page'")
    return tokens_of(docs).groupBy("rowid").agg(F.count("*").alias("tokens"), F.max("position").alias("last_position"), F.max("end").alias("last_end"), F.sum(F.length("term")).alias("characters"))


def _quoted(words: str) -> str:
    return f"""'[' || array_to_string(['"' || x || '"' for x in {words}], ', ') || ']'"""


@query("analyze_json", f"SELECT doc_id, {_quoted(_words('text'))} AS terms FROM documents")
def analyze_json(spark, folder):
    udfs.register_all(spark)
    return documents(spark, folder).select("doc_id", F.expr("ar_analyze_json(text)").alias("terms"))


@query("analyze_positions_json", PAGE + """ SELECT rowid AS doc_id, '[' || array_to_string([('{"term": "' || words[i + 1] || '", "position": ' || i || '}') for i in range(len(words))], ', ') || ']' AS terms FROM items""")
def analyze_positions_json(spark, folder):
    udfs.register_all(spark)
    return documents(spark, folder).select("doc_id", F.expr("ar_analyze_positions_json(text)").alias("terms"))


# Scalar functions


@query("sensitive_forms", "SELECT doc_id, regexp_matches(text, '[0-9]') AS digits FROM documents")
def sensitive_forms(spark, folder):
    return documents(spark, folder).select("doc_id", columns.has_sensitive_forms(F.col("text"), Forms(digits=False)).alias("digits"))


@query("arabic_sensitive_forms", f"WITH t AS (SELECT doc_id, {_arabic_sql('text')} AS t FROM documents) SELECT doc_id, contains(t, 'ً') AS diacritics, regexp_matches(t, '[آأإ]') AS hamza, regexp_matches(t, '[ىة]') AS letters, contains(t, 'ً') OR regexp_matches(t, '[آأإىة]') AS any_form FROM t")
def arabic_sensitive_forms(spark, folder):
    udfs.register_all(spark)
    rows = documents(spark, folder).select("doc_id", in_arabic(F.col("text")).alias("t"))
    one = {name: columns.has_sensitive_forms(F.col("t"), Forms(**{name: False})).alias(name) for name in ("diacritics", "hamza", "letters")}
    return rows.select("doc_id", *one.values(), (F.expr("ar_has_sensitive_forms(t, 1, 1, 1, 1)") == 1).alias("any_form"))


@query("arabic_normalize", f"WITH t AS (SELECT doc_id, {_arabic_sql('text')} AS t FROM documents) SELECT doc_id, {_normal_sql('t')} AS normal, translate(t, 'آأإ', 'ااا') AS only_hamza FROM t")
def arabic_normalize(spark, folder):
    """All distinctions ignored by the Column function, hamza alone by the SQL function."""
    udfs.register_all(spark)
    rows = documents(spark, folder).select("doc_id", in_arabic(F.col("text")).alias("t"))
    return rows.select("doc_id", columns.normalize(F.col("t")).alias("normal"), F.expr("ar_normalize(t, 0, 1, 0, 0)").alias("only_hamza"))


@query("arabic_stem", f"WITH w AS (SELECT DISTINCT {_normal_sql('x')} AS word FROM (SELECT unnest(string_split({_arabic_sql('text')}, ' ')) AS x FROM documents) WHERE length({_normal_sql('x')}) > 0) SELECT word, {_stem_sql('word')} AS stem, {_stem_sql('word')} AS by_sql FROM w")
def arabic_stem(spark, folder):
    udfs.register_all(spark)
    each = documents(spark, folder).select(F.explode(F.split(in_arabic(F.col("text")), " ")).alias("x"))
    words = each.select(columns.normalize(F.col("x")).alias("word")).where("length(word) > 0").distinct()
    return words.select("word", columns.stem(F.col("word")).alias("stem"), F.expr("ar_stem(word)").alias("by_sql"))


@query("smallfloat_roundtrip", f"SELECT n_chars, {_quantised('n_chars')} AS kept FROM (SELECT DISTINCT n_chars FROM documents)")
def smallfloat_roundtrip(spark, folder):
    docs = documents(spark, folder).select("n_chars").distinct()
    return docs.select("n_chars", columns.byte4_to_int(columns.int_to_byte4(F.col("n_chars"))).alias("kept"))


@query("idf_f32", PAGE + f", v AS (SELECT term, count(DISTINCT rowid) AS df FROM tok GROUP BY 1) SELECT term, round(CAST({_idf('n', 'df')} AS DOUBLE), 6) AS idf FROM v, st")
def idf_f32(spark, folder):
    index = corpus_index(spark, folder)
    return index.vocab("page").select("term", F.round(columns.idf(index.field_stats("page").doc_count, F.col("doc")).cast("double"), 6).alias("idf"))


def _norm(q: str) -> str:
    return f"({_real(1)} / ({_real(1.2)} * (({_real(1)} - {_real(0.75)}) + {_real(0.75)} * {_real(q)} / {_real(100)})))"


@query("norm_cache", f"WITH c AS (SELECT range AS byte, CASE WHEN range < 32 THEN range ELSE 24 + ((((range - 24) & 7) | 8) << (((range - 24) >> 3) - 1)) END AS len FROM range(256)) SELECT byte, len, round(CAST({_norm('len')} AS DOUBLE), 6) AS inverse FROM c")
def norm_cache(spark, folder):
    rows = spark.range(1).select(F.posexplode(columns.norm_inverse_cache(100.0)).alias("byte", "inverse"))
    return rows.select(F.col("byte").cast("long").alias("byte"), columns.byte4_to_int(F.col("byte")).alias("len"), F.round(F.col("inverse").cast("double"), 6).alias("inverse"))


# Lexicon


def _expansion(name: str, where: str, pattern: str) -> None:
    @query(name, PAGE + f" SELECT DISTINCT term FROM tok WHERE {where} ORDER BY term LIMIT 256")
    def run(spark, folder):
        found = corpus_index(spark, folder).vocab("page").where(columns.glob_match(F.col("term"), pattern)).select("term")
        return found.orderBy("term").limit(256)


_expansion("prefix_terms", "term LIKE 'thin%'", "thin*")
_expansion("suffix_terms", "term LIKE '%ation'", "*ation")
_expansion("wildcard_terms", "term GLOB 't?e*er'", "t?e*er")


@query("fuzzy_terms", PAGE + ", near AS (SELECT DISTINCT term FROM tok WHERE length(term) BETWEEN 2 AND 6 ORDER BY term LIMIT 1024) SELECT term FROM near WHERE levenshtein(term, '1024') <= 2 ORDER BY term LIMIT 128")
def fuzzy_terms(spark, folder):
    index = corpus_index(spark, folder)
    return spark.createDataFrame([(t,) for t in index.expand_fuzzy("page", "1024", 2, 128)], "term string")


# Ranking


@query("bm25_single_term", PAGE + _term("a", "the") + f" SELECT book_id, item_id, {_ROUNDED} FROM a")
def bm25_single_term(spark, folder):
    return _hits(Ranker(corpus_index(spark, folder), "page").term("the"))


@query("bm25_top20", PAGE + _term("a", "that") + f" SELECT 'page' AS field, book_id, item_id, {_ROUNDED} FROM a ORDER BY a.score, book_id, item_id LIMIT 20")
def bm25_top20(spark, folder):
    hits = Engine(corpus_index(spark, folder)).search("that", "page", 20).hits
    return hits.select("field", "book_id", "item_id", F.round("score", 6).alias("score"))


@query("bm25_and", PAGE + _term("a", "that") + _term("b", "with") + " " + _merged("", "a", "b"))
def bm25_and(spark, folder):
    return _hits(Ranker(corpus_index(spark, folder), "page").lucene("that AND with"))


@query("bm25_or", PAGE + _term("a", "that") + _term("b", "with") + " " + _merged("FULL", "a", "b"))
def bm25_or(spark, folder):
    return _hits(Ranker(corpus_index(spark, folder), "page").lucene("that OR with"))


@query("bm25_boosted_or", PAGE + _term("a", "that") + _term("b", "with") + " " + _merged("FULL", "a", "b", 2.5, 0.5))
def bm25_boosted_or(spark, folder):
    return _hits(Ranker(corpus_index(spark, folder), "page").lucene("that^2.5 OR with^0.5"))


@query("phrase_two_term", PAGE + _phrase("p", ["of", "the"], 0) + f" SELECT book_id, item_id, {_ROUNDED} FROM p")
def phrase_two_term(spark, folder):
    return _hits(Ranker(corpus_index(spark, folder), "page").lucene('"of the"'))


@query("phrase_slop", PAGE + _phrase("p", ["of", "the"], 4) + f" SELECT book_id, item_id, {_ROUNDED} FROM p")
def phrase_slop(spark, folder):
    return _hits(Ranker(corpus_index(spark, folder), "page").lucene('"of the"~4'))


@query("phrase_three_term", PAGE + _phrase("p", ["the", "of", "and"], 3) + f" SELECT book_id, item_id, {_ROUNDED} FROM p")
def phrase_three_term(spark, folder):
    return _hits(Ranker(corpus_index(spark, folder), "page").lucene('"the of and"~3'))


@query("phrase_term_boolean", PAGE + _phrase("p", ["of", "the"], 0) + _term("a", "that") + " " + _merged("FULL", "p", "a", 3, 1))
def phrase_term_boolean(spark, folder):
    return _hits(Ranker(corpus_index(spark, folder), "page").lucene('"of the"^3 OR that'))


@query("constant_wildcard_hits", PAGE + " SELECT DISTINCT book_id, item_id, CAST(-1.0 AS DOUBLE) AS score FROM tok WHERE term LIKE 'thin%'")
def constant_wildcard_hits(spark, folder):
    return _hits(search_field(corpus_index(spark, folder), "page", "thin*", SearchOptions(), None)[1])


def _match(name: str, q: str, sql: str) -> None:
    @query(name, PAGE + " " + sql)
    def run(spark, folder):
        index = corpus_index(spark, folder)
        return matches(index, "page", Compiler(index, "page").query(q).node).select("rowid")


def _has(*terms: str) -> str:
    return f"SELECT DISTINCT rowid FROM tok WHERE term IN ({', '.join(map(_sql_text, terms))})"


_match("match_not", "+the -that", f"{_has('the')} EXCEPT {_has('that')}")
_match("match_nested", "(this OR with) AND (from OR by) AND NOT are", f"({_has('this', 'with')} INTERSECT {_has('from', 'by')}) EXCEPT {_has('are')}")
_match("match_prefix", "thin* AND that", f"SELECT DISTINCT rowid FROM tok WHERE term LIKE 'thin%' INTERSECT {_has('that')}")
_match("match_phrase", '"in the" OR "to be"', "SELECT DISTINCT a.rowid FROM tok a JOIN tok b ON a.rowid = b.rowid AND b.off = a.off + 1 WHERE (a.term, b.term) IN (('in', 'the'), ('to', 'be'))")
_match("match_near", '"this that"~3', "SELECT DISTINCT a.rowid FROM tok a JOIN tok b ON a.rowid = b.rowid AND a.term = 'this' AND b.term = 'that' AND abs(a.off - b.off) <= 4")


_match("match_near_three", '"this that with"~6', "SELECT DISTINCT e.rowid FROM tok e WHERE e.term IN ('this', 'that', 'with')" + "".join(f" AND EXISTS (SELECT 1 FROM tok x WHERE x.rowid = e.rowid AND x.term = '{t}' AND x.off <= e.off AND e.off - x.off <= 7)" for t in ("this", "that", "with")))


def _row_bm25(terms: list[str], where: str) -> str:
    """Items' scores over single terms, and phrases of two: f0, f1, ... are how often each occurs."""
    single = [(i, t) for i, t in enumerate(terms) if " " not in t]
    counts = ", ".join(f"count(*) FILTER (WHERE term = '{t}') AS f{i}" for i, t in single)
    pairs = ""
    for i, t in enumerate(terms):
        if " " in t:
            first, second = t.split()
            pairs += f" LEFT JOIN (SELECT a.rowid, count(*) AS f{i} FROM tok a JOIN tok b ON a.rowid = b.rowid AND b.off = a.off + 1 WHERE a.term = '{first}' AND b.term = '{second}' GROUP BY 1) USING (rowid)"
    every = ", ".join(f"coalesce(f{i}, 0) AS f{i}" for i in range(len(terms)))
    ns = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(terms)))
    norm = "1.2 * (0.25 + 0.75 * len / (tokens / rows))"
    parts = " + ".join(f"greatest(ln((rows - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + {norm})" for i in range(len(terms)))
    return f""",
per0 AS (SELECT rowid, book_id, item_id, CAST(count(*) AS DOUBLE) AS len, {counts} FROM tok GROUP BY 1, 2, 3),
per AS (SELECT rowid, book_id, item_id, len, {every} FROM per0{pairs}),
tot AS (SELECT {ns} FROM per),
siz AS (SELECT CAST((SELECT count(*) FROM documents) AS DOUBLE) AS rows, CAST((SELECT count(*) FROM tok) AS DOUBLE) AS tokens),
scored AS (SELECT *, -({parts}) AS score FROM per, tot, siz WHERE {where})"""


def _boosted(factor: str) -> str:
    return f" SELECT book_id, item_id, round(CASE WHEN {factor} = 1 THEN score ELSE CAST({_real('score')} * {_real(factor)} AS DOUBLE) END, 6) AS score FROM scored"


@query("row_bm25", PAGE + _row_bm25(["this", "with", "from"], "(f0 > 0 OR f1 > 0) AND f2 > 0") + f" SELECT book_id, item_id, {_ROUNDED} FROM scored")
def row_bm25_hits(spark, folder):
    index = corpus_index(spark, folder)
    return _hits(row_bm25(index, "page", Compiler(index, "page").query("(this OR with) AND from").node))


def _clause_boosts(name: str, q: str, terms: list[str], where: str, factor: str) -> None:
    @query(name, PAGE + _row_bm25(terms, where) + _boosted(factor))
    def run(spark, folder):
        return _hits(search_field(corpus_index(spark, folder), "page", q, SearchOptions(), None)[1])


_clause_boosts("clause_boosts", "this^2 with", ["this", "with"], "f0 > 0 OR f1 > 0", "CASE WHEN f0 > 0 THEN 2 ELSE 1 END")
_clause_boosts("group_boosts", "(this with)^3 from^2", ["this", "with", "from"], "f0 > 0 OR f1 > 0 OR f2 > 0", "CASE WHEN f2 > 0 THEN 2 ELSE 1 END * CASE WHEN f0 > 0 OR f1 > 0 THEN 3 ELSE 1 END")
_clause_boosts("phrase_boosts", '"of the"^2 that with^0.5', ["of the", "that", "with"], "f0 > 0 OR f1 > 0 OR f2 > 0", "CASE WHEN f2 > 0 THEN 0.5 ELSE 1 END * CASE WHEN f0 > 0 THEN 2 ELSE 1 END")


def _both() -> str:
    def part(field: str, items: str) -> str:
        return f"SELECT * FROM (WITH{items}{TOKENS}{_term('a', 'the')} SELECT '{field}' AS field, book_id, item_id, score FROM a ORDER BY score, book_id, item_id LIMIT 20)"

    return f"SELECT field, book_id, item_id, {_ROUNDED} FROM ({part('page', ITEMS)} UNION ALL {part('title', TITLES)}) u ORDER BY u.score, field, book_id, item_id LIMIT 20"


@query("both_fields_merge", _both())
def both_fields_merge(spark, folder):
    hits = Engine(corpus_index(spark, folder)).search("the", "both", 20).hits
    return hits.select("field", "book_id", "item_id", F.round("score", 6).alias("score"))


_BATCH = {"q1": "that", "q2": "with", "q3": "from", "q4": "this"}


@query("batch_top_k", PAGE + "".join(_term(k, t) for k, t in _BATCH.items()) + ", u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS query_id, * FROM {k}" for k in _BATCH) + f"), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, book_id, item_id) AS rank FROM u) SELECT query_id, book_id, item_id, {_ROUNDED}, rank FROM r WHERE rank <= 10")
def batch_top_k(spark, folder):
    rows = Engine(corpus_index(spark, folder)).batch_terms(_BATCH, "page", 10)
    return rows.select("query_id", "book_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("strict_digits", "SELECT doc_id FROM documents WHERE contains(text, '12') AND NOT contains(text, '99')")
def strict_digits(spark, folder):
    return documents(spark, folder).where(strict_filter(F.col("text"), "+the +12 -99", "page", Forms(digits=False))).select("doc_id")


@query("wildcard_match", "SELECT doc_id, regexp_matches(text, 'th.*ing.er') AS found, CAST(regexp_matches(text, 'th.*ing.er') AS INTEGER) AS by_sql FROM documents")
def wildcard_match(spark, folder):
    udfs.register_all(spark)
    return documents(spark, folder).select("doc_id", columns.wildcard_match(F.col("text"), "th*ing?er").alias("found"), F.expr("ar_wildcard_match(text, 'th*ing?er')").alias("by_sql"))


# In Arabic letters: stop words take positions but no offsets, spellings and stems are alike


@query("arabic_tokens_count", ARABIC + " SELECT rowid, count(*) AS tokens FROM tok GROUP BY 1")
def arabic_tokens_count(spark, folder):
    return corpus_index(spark, folder, "arabic").table("row_lengths").select("rowid", F.col("len").alias("tokens"))


@query("arabic_postings", ARABIC + " SELECT term, rowid, count(*) AS tf, CAST(sum(off) AS BIGINT) AS offsets, CAST(sum(pos) AS BIGINT) AS positions FROM tok GROUP BY 1, 2")
def arabic_postings(spark, folder):
    sums = [F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).alias(c) for c in ("offsets", "positions")]
    return corpus_index(spark, folder, "arabic").postings("page").select("term", "rowid", F.col("tf").cast("long").alias("tf"), *sums)


@query("arabic_bm25_or", ARABIC + _term("a", _term_of("that")) + _term("b", _term_of("with")) + " " + _merged("FULL", "a", "b"))
def arabic_bm25_or(spark, folder):
    return _hits(Ranker(corpus_index(spark, folder, "arabic"), "page").lucene(_arabic("that") + " OR " + _arabic("with")))


_ON_STOP = [_term_of("that"), _term_of("the")]


@query("arabic_phrase_over_stop_word", ARABIC + _phrase("p", _ON_STOP, 3, "pos", [0, 2]) + f" SELECT book_id, item_id, {_ROUNDED} FROM p")
def arabic_phrase_over_stop_word(spark, folder):
    """A stop word within a phrase is a place: how often it occurs is counted by positions."""
    return _hits(Ranker(corpus_index(spark, folder, "arabic"), "page").lucene('"' + _arabic("that in the") + '"~3'))


@query("arabic_match_phrase", ARABIC + f" SELECT DISTINCT a.rowid FROM tok a JOIN tok b ON a.rowid = b.rowid AND abs(b.off - a.off) <= 2 WHERE a.term = '{_ON_STOP[0]}' AND b.term = '{_ON_STOP[1]}'")
def arabic_match_phrase(spark, folder):
    """A match is by offsets, which stop words don't take; one within a phrase lets its terms be as much farther apart."""
    index = corpus_index(spark, folder, "arabic")
    return matches(index, "page", Compiler(index, "page").query('"' + _arabic("that in the") + '"').node).select("rowid")


@query("arabic_strict", f"WITH t AS (SELECT doc_id, {_arabic_sql('text')} AS t FROM documents) SELECT doc_id, contains(translate(replace(t, 'ً', ''), 'ىة', 'يه'), 'يلأ') AS hamza, contains(translate(t, 'أإىة', 'اايه'), 'ًاف') AS diacritics, NOT contains(translate(replace(t, 'ً', ''), 'أإ', 'اا'), 'ىلا') AS letters FROM t")
def arabic_strict(spark, folder):
    text = in_arabic(F.col("text"))
    asked = {"hamza": ("+" + _arabic("you"), Forms(hamza=False)), "diacritics": ("+" + _arabic("qui"), Forms(diacritics=False)), "letters": (_arabic("the") + " -" + _arabic("you"), Forms(letters=False))}
    return documents(spark, folder).select("doc_id", *[strict_filter(text, q, "page", forms).alias(name) for name, (q, forms) in asked.items()])


# Spans, highlights, snippets


def _places(pattern: str, text: str = "text") -> str:
    """(doc_id, k, start, stop, found) of all matches of a pattern, from the left."""
    return f"""
cut AS (SELECT doc_id, regexp_extract_all({text}, {pattern}) AS hits, regexp_split_to_array({text}, {pattern}) AS gaps FROM documents),
each AS (SELECT doc_id, unnest(hits) AS found, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS k FROM cut),
places AS (SELECT doc_id, k, found, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM each)"""


#: A limit that no text reaches.
_ALL = 2**31 - 1


@query("normalized_spans", "WITH" + _places("'that'", _fold("text")) + " SELECT doc_id, CAST(k AS INTEGER) AS n, CAST(stop - 4 AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM places")
def normalized_spans(spark, folder):
    each = documents(spark, folder).select("doc_id", F.posexplode(udfs.normalized_spans(F.col("text"), F.lit("that"), F.lit(_ALL))).alias("n", "s"))
    return each.select("doc_id", "n", "s.start", F.col("s.end").alias("stop"))


@query(
    "analyzed_spans",
    "WITH" + _places(TOKEN) + f", two AS (SELECT *, {_fold('found')} AS term FROM places WHERE {_fold('found')} IN ('that', 'with')), good AS (SELECT doc_id FROM two GROUP BY 1 HAVING count(DISTINCT term) = 2) "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY term, k) - 1 AS INTEGER) AS n, CAST(stop - length(found) AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM two JOIN good USING (doc_id)",
)
def analyzed_spans(spark, folder):
    each = documents(spark, folder).select("doc_id", F.posexplode(udfs.analyzed_spans(F.col("text"), F.array(F.lit("that"), F.lit("with")), F.lit("all"), F.lit(_ALL))).alias("n", "s"))
    return each.select("doc_id", "n", "s.start", F.col("s.end").alias("stop"))


@query("highlight_all", f"SELECT doc_id, regexp_replace(text, '([Tt][Hh][Aa][Tt]|[Ww][Ii][Tt][Hh])', '<b>\\1</b>', 'g') AS marked FROM documents WHERE contains({_fold('text')}, 'that') AND contains({_fold('text')}, 'with')")
def highlight_all(spark, folder):
    text = udfs.highlight_normalized(F.col("text"), F.array(F.lit("that"), F.lit("with")), F.lit("all"), F.lit("<b>"), F.lit("</b>"), F.lit(_ALL))
    return documents(spark, folder).select("doc_id", text.alias("marked")).where("marked is not null")


@query("highlight_analyzed", "WITH" + _places(TOKEN) + f", whole AS (SELECT doc_id, regexp_split_to_array(text, {TOKEN}) AS gaps, regexp_extract_all(text, {TOKEN}) AS hits FROM documents) SELECT doc_id, array_to_string([CASE WHEN i = 0 THEN gaps[1] ELSE (CASE WHEN {_fold('hits[i]')} = 'that' THEN '<b>' || hits[i] || '</b>' ELSE hits[i] END) || gaps[i + 1] END for i in range(len(gaps))], '') AS marked FROM whole WHERE list_contains([{_fold('x')} for x in hits], 'that')")
def highlight_analyzed(spark, folder):
    text = udfs.highlight_analyzed(F.col("text"), F.array(F.lit("that")), F.lit("any"), F.lit("<b>"), F.lit("</b>"), F.lit(_ALL), F.lit(None).cast("array<string>"))
    return documents(spark, folder).select("doc_id", text.alias("marked")).where("marked is not null")


@query("select_spans", "WITH" + _places("'the?'") + " SELECT doc_id, CAST(stop - length(found) AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM places")
def select_spans(spark, folder):
    """Of all places of "the" and, after these, of "th": those that don't overlap."""
    docs = documents(spark, folder).select("doc_id", "text")
    found = [F.transform(udfs.normalized_spans(F.translate("text", _UPPER, "-" * 26), F.lit(t), F.lit(_ALL)), lambda s, p=p: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(p).alias("priority"))) for p, t in enumerate(("the", "th"))]
    each = docs.select("doc_id", F.explode(columns.select_spans(F.concat(*found))).alias("s"))
    return each.select("doc_id", "s.start", F.col("s.end").alias("stop"))


_BREAK = r"""[\s`~!@#$%^&*()\-_=+\[{\]}\\|;:''",<.>/?،؛«»…]"""


@query(
    "snap_window",
    f"WITH w AS (SELECT doc_id, length(text) // 2 AS s, least(length(text) // 2 + 10, length(text)) AS e, text FROM documents), "
    f"c AS (SELECT *, substr(text, greatest(s - 12, 0) + 1, least(s, 12)) AS before, substr(text, e + 1, 12) AS after FROM w), "
    f"f AS (SELECT *, length(regexp_extract(before, '[^{_BREAK[1:]}*$')) AS back, length(regexp_extract(after, '^[^{_BREAK[1:]}*')) AS ahead FROM c), "
    f"x AS (SELECT doc_id, s, e, CASE WHEN back < length(before) THEN s - back ELSE s END AS l, CASE WHEN ahead < length(after) THEN e + ahead ELSE e END AS r FROM f) "
    'SELECT doc_id, CAST(CASE WHEN r > l THEN l ELSE s END AS INTEGER) AS start, CAST(CASE WHEN r > l THEN r ELSE greatest(e, s) END AS INTEGER) AS stop, \'{"start": \' || CASE WHEN r > l THEN l ELSE s END || \', "end": \' || CASE WHEN r > l THEN r ELSE greatest(e, s) END || \'}\' AS by_sql FROM x',
)
def snap_window(spark, folder):
    """A window around the middle of each document, pushed outward to breaks."""
    udfs.register_all(spark)
    middle = F.floor(F.length("text") / 2).cast("int")
    rows = documents(spark, folder).select("doc_id", "text", middle.alias("s"), (middle + 10).alias("e"))
    found = rows.select("doc_id", columns.snap_window(F.col("text"), F.col("s"), F.col("e")).alias("w"), F.expr("ar_snap_snippet_window_json(text, s, e)").alias("by_sql"))
    return found.select("doc_id", "w.start", F.col("w.end").alias("stop"), "by_sql")


@query("snippets")
def snippets(spark, folder):
    """Every document's best snippet for a query."""
    found = documents(spark, folder).select("doc_id", udfs.build_snippet(F.col("text"), F.lit('"of the" OR that')).alias("s"))
    return found.select("doc_id", "s.*")


# The query language, with words of each document

#: SQL function -> the query (aaaa, bbbb, cccc stand for a document's words), and what it gives for it.
_CALLS = {
    "ar_parse_scoped_token_json": ("title:aaaa", '{"scope": "title", "raw": "aaaa"}'),
    "ar_strip_boost_json": ("aaaa^2.5", '{"base": "aaaa", "boost": 2.5}'),
    "ar_parse_fuzzy_token_json": ("aaaa~1", '{"base": "aaaa", "edits": 1}'),
    "ar_parse_phrase_query_json": ('"aaaa bbbb"~3', '{"phrase": "aaaa bbbb", "slop": 3}'),
    "ar_parse_single_phrase_clause_json": ('title:"aaaa bbbb"~2^3', '{"scope": "title", "phrase": "aaaa bbbb", "slop": 2, "boost": 3.0}'),
    "ar_parse_simple_boolean_json": ("aaaa^2 OR bbbb", '{"op": "OR", "left": "aaaa", "left_boost": 2.0, "right": "bbbb", "right_boost": 1.0}'),
    "ar_parse_top_level_group_boost_json": ("(aaaa bbbb)^4", '{"inner": "aaaa bbbb", "boost": 4.0}'),
    "ar_parse_whole_scoped_group_json": ("title:(aaaa bbbb)^3", '{"scope": "title", "inner": "aaaa bbbb", "boost": 3.0}'),
    "ar_iter_query_ast_leaves_json": ('aaaa AND (bbbb OR -cccc) title:"aaaa bbbb"~2', '[{"occur": "MUST", "kind": "token", "value": "aaaa"}, {"occur": "SHOULD", "kind": "token", "value": "bbbb"}, {"occur": "MUST_NOT", "kind": "token", "value": "cccc"}, {"occur": "SHOULD", "kind": "field_phrase_slop", "value": "title:2\\taaaa bbbb"}]'),
    "ar_extract_boosted_phrase_spans_json": ('"aaaa bbbb"^2 cccc', '[{"scope": null, "phrase": "aaaa bbbb", "slop": 0, "boost": 2.0}]'),
    "ar_extract_snippet_query_terms_json": ('+aaaa -bbbb title:"cccc aaaa"', '["aaaa", "bbbb", "cccc"]'),
    "ar_extract_snippet_query_phrases_json": ('"aaaa bbbb" OR cccc', '["aaaa bbbb"]'),
}
_FIELD_CALLS = {
    "ar_preprocess_rank_boost_json": ("(aaaa bbbb)^4", '{"boost_factor": 4.0, "ranking_query": "aaaa bbbb"}'),
    "ar_parse_boosted_token_clause_json": ("page:aaaa*^2", '{"scope": "page", "raw": "aaaa*", "boost": 2.0, "has_wildcard": true, "is_fuzzy": false}'),
    "ar_extract_boosted_group_spans_json": ("(aaaa bbbb)^3 cccc", '[{"inner": "aaaa bbbb", "boost": 3.0}]'),
}
_PLACES = ("aaaa", "bbbb", "cccc")
#: Three words of a document that differ in their first letters.
_THREE = "WITH w AS (SELECT doc_id, 'q' || regexp_extract(text, '[a-z]{4,}') AS a, 'x' || regexp_extract(text, '[a-z]{5,}') AS b, 'z' || regexp_extract(text, '[a-z]{6,}') AS c FROM documents)"


def _filled(template: str) -> str:
    out = _sql_text(template)
    for place, word in zip(_PLACES, "abc"):
        out = f"replace({out}, '{place}', {word})"
    return out


@query("query_functions", _THREE + " SELECT doc_id, " + ", ".join(f"{_filled(want)} AS {name}" for name, (_, want) in (_CALLS | _FIELD_CALLS).items()) + " FROM w")
def query_functions(spark, folder):
    """Every helper of the query language as a SQL function, on a query for each document."""
    udfs.register_all(spark)
    words = [F.concat(F.lit(c), F.regexp_extract("text", f"[a-z]{{{n},}}", 0)) for c, n in zip("qxz", (4, 5, 6))]

    def filled(q: str) -> Column:
        out = F.lit(q)
        for place, word in zip(_PLACES, "abc"):
            out = F.replace(out, F.lit(place), F.col(word))
        return out

    rows = documents(spark, folder).select("doc_id", *[w.alias(n) for w, n in zip(words, "abc")])
    return rows.select("doc_id", *[F.call_function(n, filled(q)).alias(n) for n, (q, _) in _CALLS.items()], *[F.call_function(n, filled(q), F.lit("page")).alias(n) for n, (q, _) in _FIELD_CALLS.items()])


@query("explain_counts", PAGE + " SELECT term AS clause, count(DISTINCT rowid) AS hits FROM tok WHERE term IN ('that', 'with', 'from') GROUP BY 1")
def explain_counts(spark, folder):
    index = corpus_index(spark, folder)
    compiler = Compiler(index, "page")
    out = None
    for t in ("that", "with", "from"):
        rows = matches(index, "page", compiler.query(t).node).agg(F.count("*").alias("hits")).select(F.lit(t).alias("clause"), "hits")
        out = rows if out is None else out.union(rows)
    return out


# Ingest


@query("ingest_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def ingest_latest(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return latest(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("ingest_upsert", "SELECT doc_id, 'document' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'label' FROM labels")
def ingest_upsert(spark, folder):
    held = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.lit("document").alias("kind"))
    new = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id").distinct().withColumn("kind", F.lit("label"))
    return upsert(held, new, ["doc_id"])


@query(
    "ingest_stream",
    "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN text || ' revised' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0), "
    f"tok AS (SELECT doc_id AS rowid, unnest({_words('text')}) AS term FROM n) SELECT rowid, term, count(*) AS tf FROM tok GROUP BY 1, 2",
)
def ingest_stream(spark, folder):
    """All documents are streamed in; a later batch revises a fifth of them, deletes another and repeats the rest."""
    path = fresh_path(spark, "stream")
    docs = documents(spark, folder).select(F.lit("page").alias("field"), F.col("doc_id").alias("rowid"), F.lit(1).cast("long").alias("book_id"), F.col("doc_id").alias("item_id"), "text", F.lit(0).alias("source_deleted"))
    turn = F.pmod("rowid", F.lit(5))
    revised = docs.withColumns({"text": F.when(turn == 1, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")), "source_deleted": F.when(turn == 0, 1).otherwise(0)})
    for rows in (docs, revised):
        rows.write.mode("append").parquet(f"{path}/in")
        ingest.start(ingest.read_items(spark, f"{path}/in", "parquet"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return ingest.current_postings(spark, f"{path}/out").select("rowid", "term", F.col("tf").cast("long").alias("tf"))
