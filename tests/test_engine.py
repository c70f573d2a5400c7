"""Search end to end: parsing, compiling, ranking, strictness, snippets, SQL functions, ingestion, command line."""

import base64
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sahifa import catalogue, cli
from sahifa.engine import Engine, SearchOptions, result_json
from sahifa.functions import spans, udfs
from sahifa.functions.analyzer import AnalyzerOptions, analyze
from sahifa.operators.index import DOC_SCHEMA, build_index
from sahifa.plans import syntax
from sahifa.plans.syntax import QueryError
from sahifa.sources import corpus, readers, sinks
from sahifa.streaming import ingest

PAGES = {
    11: "المنصور باحث في اللغة", 12: "المصور يكتب المقال", 13: "قُرْآن وإيمان ١٢٣", 14: "والكتاب مفيد", 15: "إلتي نافعة", 16: "قران وايمان 123",
    17: "مشروبات نافعة", 18: "كاتب امريكي", 19: "الكاتب بارع", 20: "الشاعر بارع", 21: "طريق العلم نافع", 22: "طريق الادب نافع", 23: "مدرسة متقدمة",
    24: "مدرسه متقدمه", 25: 'قال "العلم نور" للطلاب',
}
TITLES = {21: "باب المنصور", 22: "باب المصور"}
RANKED = ["منصور في اللغة", "منصور منصور في اللغة", "مصور في اللغة", "طريق العلم نافع", "طريق طويل إلى العلم النافع", "قال العلم نور للطلاب", "العلم نور للطلاب", "نور العلم نور", "كتاب مفيد", "كتاب مفيد"]


def make(spark, path, pages, titles=(), options=None, book=10):
    rows = [("page", n, book, i, t) for n, (i, t) in enumerate(pages, 1)] + [("title", n, book, i, t) for n, (i, t) in enumerate(titles, 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    return Engine(build_index(docs, str(path), options) if options else build_index(docs, str(path)))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("i") / "x", PAGES.items(), TITLES.items())


@pytest.fixture(scope="module")
def ranked(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("r") / "x", enumerate(RANKED, 101), enumerate(["باب منصور", "باب العلم نور", "كتاب مفيد", "كتاب مفيد"], 201))


# Scores of one book: doc_count is 1, so a term in several items has a negative weight.
SCORES = {
    "منصور": [(101, 0.10142888), (102, 0.13946471)],
    "منصور AND اللغة": [(101, 0.35579967), (102, 0.39383551)],
    "منصور OR مصور": [(103, -0.13076457), (101, 0.10142888), (102, 0.13946471)],
    '"العلم نور"': [(106, 0.71418941), (107, 0.71418941), (108, 0.71418941)],
    '"طريق العلم"~3': [(104, 0.56124747), (105, 0.56124747)],
    "منصور^2 OR مصور": [(103, -0.13076457), (101, 0.20285776), (102, 0.27892936)],
    '"العلم نور"^3 OR طريق': [(104, 0.10142888), (105, 0.10142888), (106, 2.14256811), (107, 2.14256811), (108, 2.14256811)],
    "كتاب": [(109, 0.10142888), (110, 0.10142888)],
    "(كتاب)^2": [(109, 0.20285776), (110, 0.20285776)],
}


@pytest.mark.parametrize("q,hits", SCORES.items())
def test_scores(ranked, q, hits):
    rows = ranked.search(q, "page", 10).rows()
    assert [r["item_id"] for r in rows] == [i for i, _ in hits]
    assert all(abs(r["score"] - s) < 1e-6 for r, (_, s) in zip(rows, hits))


def test_both_fields_and_limits(ranked):
    rows = ranked.search("كتاب", "both", 3).rows()
    assert [(r["field"], r["item_id"]) for r in rows] == [("page", 109), ("page", 110), ("title", 203)]
    assert len(ranked.search("منصور OR العلم", "page", 2).rows()) == 2


PREFIX_OFF, RESPECT = SearchOptions(allow_prefix=False), SearchOptions(ignore_diacritics=False)
FOUND = [
    ("منص*", "page", {}, [11]), ("*صور", "page", {}, [11, 12]), ("م*ور", "page", {}, [11, 12]), ("م*ور", "page", {"wildcard_expansions": 1}, [12]), ("?صور", "page", {}, [12]),
    ("م\\*ور", "page", {}, []), ("*صور*", "title", {}, [21, 22]), ("قران AND ايمان AND 123", "page", {}, [13, 16]), ("إلتي", "page", {}, [15]), ("التي", "page", {}, []),
    ("المنصور AND هذا", "page", {}, [11]), ("هذا AND المنصور", "page", {}, [11]), ("عليه AND هذا", "page", {}, []), ("منصور~1", "page", {}, [11, 12]),
    ("طريق -العلم", "page", {}, [22]), ("+طريق +نافع -العلم", "page", {}, [22]), ("NOT طريق", "page", {}, []), ("(المنصور OR المصور) AND اللغة", "page", {}, [11]),
    ("title:المنصور", "page", {}, []), ("title:المنصور", "title", {}, [21]), ("title:(المنصور OR المصور)^2", "title", {}, [21, 22]), ('"المنصور في اللغة"', "page", {}, []), ('"المنصور باحث"', "page", {}, [11]),
    ('"باحث اللغة"~1', "page", {}, [11]), ('"باحث اللغة"', "page", {}, []), ('"\\"العلم نور\\""', "page", {}, [25]), ("title\\:المصور", "page", {}, []), ("مدرسة", "page", {}, [23, 24]),
    ("مدرسة", "page", {"ignore_letter_forms": False}, [23]), ("قُرْآن", "page", {}, [13, 16]), ("قُرْآن", "page", {"ignore_diacritics": False}, [13]), ("إيمان", "page", {"ignore_hamza_forms": False}, [13]),
    ("١٢٣", "page", {"ignore_digit_forms": False}, [13]), ("123", "page", {"ignore_digit_forms": False}, [16]), ("قُرْآن OR طريق", "page", {"ignore_diacritics": False}, [13, 21, 22]),
    ("مدرس* -مدرسه", "page", {"ignore_letter_forms": False}, []), ("المنصور^2 المصور", "page", {}, [11, 12]),
]


@pytest.mark.parametrize("q,field,options,ids", FOUND)
def test_hits(engine, q, field, options, ids):
    assert sorted(r["item_id"] for r in engine.search(q, field, 20, SearchOptions(**options)).rows()) == ids


COMPILED = {
    "المنصور AND المصور": '("المنصور") AND ("المصور")', '"المنصور في اللغة"': '(NEAR("منصور" "لغ", 1))', '"المنصور في اللغة"~2': '(NEAR("منصور" "لغ", 3))', "page:(المنصور OR المصور)": '("المنصور") OR ("المصور")',
    "title:(المنصور)": '("__nohit__")', "+المنصور -مزور": '(("المنصور")) NOT (("مزور"))', "منص*": '("منص"*)', "*صور": '(("مصور" OR "منصور"))', "هذا": '"__nohit__"', "a b AND c": '("b") AND ("c")',
}


@pytest.mark.parametrize("q,text", COMPILED.items())
def test_compiled(engine, q, text):
    want = text if q not in ("هذا",) else '"__nohit__"'
    assert engine.compile(q, "page")["page"] == want


ERRORS = {
    "title:": "dangling field scope", '"غير مغلق': "unclosed quote", "(a": "unclosed group", "a)": "unmatched closing", "AND a": "dangling boolean", "a AND": "dangling boolean", "a AND OR b": "consecutive", "NOT": "dangling NOT", "a +": "dangling \\+",
    "+ AND a": "before boolean", "(- )": "before closing", "title:(a": "unclosed field-group", "(a)^1.2.3": "group boost", '"a"^x': "phrase boost", '"a b"~x': "phrase slop", "^2": "boosted token", "*": "literal character", "a[b": "unsupported wildcard", "": "empty",
}


@pytest.mark.parametrize("q,message", ERRORS.items())
def test_errors(engine, q, message):
    with pytest.raises(QueryError, match=message):
        engine.search(q, "page")
    if q:
        result = engine.search(q, "page", options=SearchOptions(lenient=True))
        assert result.rows() == [] and result.compiled == {"page": '"__nohit__"'}


@pytest.mark.parametrize("q,switch", [("منص*", "allow_prefix"), ("*صور", "allow_suffix"), ("م*ور", "allow_wildcard"), ("منصور~1", "allow_fuzzy")])
def test_policies(engine, q, switch):
    with pytest.raises(QueryError, match="disabled by policy"):
        engine.search(q, "page", options=SearchOptions(**{switch: False}))


def test_limits_and_fields_are_checked(engine):
    for bad in ({"field": "body"}, {"limit": 0}):
        with pytest.raises(QueryError):
            engine.search("a", **bad)


def test_rendered_queries_parse_alike():
    for q in ("a AND (b OR -c)", 'title:"x \\"y\\" z"~3 page:(a b)^2 +d', '"p\\\\q" NOT r', "t:u \\(v\\)"):
        tokens = syntax.split(q)
        assert syntax.split(syntax.render(tokens)) == tokens and syntax.parse(syntax.render(tokens)) == syntax.parse(q)


def test_any_partitioning_gives_the_same_rows(spark, tmp_path):
    found = []
    for n in (1, 7):
        docs = catalogue.table_documents(spark, "/root/testdata/sf0.001").repartition(n)
        index = build_index(docs, str(tmp_path / str(n)))
        found.append([Engine(index).search(q, "both", 30).rows() for q in ("the", 'of AND "in the"', "that^2 with", "thin*")])
    assert found[0] == found[1]


def test_custom_analysis_reaches_matching_only(spark, tmp_path):
    own = make(spark, tmp_path / "x", enumerate(["the fox", "a fox in the box"], 1), options=AnalyzerOptions.parse("stopwords", "the"))
    assert own.search("fox", "page").rows()
    assert [t["term"] for t in own.probe("the fox")] == ["fox"] and analyze("the fox") == ["the", "fox"]


def test_batch_is_the_single_searches(ranked):
    batch = ranked.batch_terms({"a": "منصور", "b": "كتاب", "c": "nothing"}, "page", 5).collect()
    for k, q in (("a", "منصور"), ("b", "كتاب")):
        assert [(r.item_id, r.score) for r in sorted(batch, key=lambda r: r["rank"]) if r.query_id == k] == [(r["item_id"], r["score"]) for r in ranked.search(q, "page", 5).rows()]


def test_explain(engine):
    found = engine.explain("م*ور OR طريق", "page", 5)
    assert {c["clause"]: c["hits"] for c in found["clauses"]} == {"م*ور": 2, "طريق": 2}
    assert found["counts"]["relaxed"] == 4 and "Scan" in found["plan"] or "Relation" in found["plan"]


def test_explain_names_every_expansion(engine):
    found = engine.explain("منص* OR *صور OR م*ور OR منصور~1 OR zz*q", "page", 20)["expansions"]
    assert [(e["kind"], e["token"], e["normalized"], e["expansions"], e["expansion_count"], e["hits"]) for e in found] == [
        ("prefix", "منص*", "منص", [], 0, 1),
        ("suffix", "*صور", "*صور", ["مصور", "منصور"], 2, 2),
        ("wildcard", "م*ور", "م*ور", ["مصور", "منصور"], 2, 2),
        ("fuzzy", "منصور~1", "منصور", ["مصور", "منصور"], 2, 2),
        ("wildcard", "zz*q", "zz*q", [], 0, 0),
    ]


def test_explain_asserts_on_relaxed_and_strict_hits(engine):
    asked = {"relaxed": {"min_hits": 2, "must_include": ["10:13", "10:99"]}, "strict": {"max_hits": 0}, "cross": {"strict_at_most_relaxed": True, "counts_differ": True}}
    found = engine.explain("قُرْآن", "page", 20, assertions=asked)["assertions"]
    assert found["relaxed"] == {"pass": False, "failures": ["missing expected item 10:99"]}
    assert found["strict"] == {"pass": False, "failures": ["expected at most 0 hits, got 1"]} and found["cross"] == {"pass": True, "failures": []}


SNIPPETS = [
    ('"طريق العلم"~2', "طريقُ العِلمِ طويل، لكن طريق العلم نافع لمن صبر.", "[[طريقُ العِلم]]ِ طويل، لكن [[طريق العلم]] نافع…"),
    ("123^5 OR ١٢٣", "رقم ١٢٣ ورقم 123 متساويان", "[[ر]]قم ١٢٣ ورقم 123 متساويان"),
    ('"العلم نور" OR العلم', "قال الكاتب: العلم نور، والعلم عمل", "قال الكاتب: [[العلم نور]]، و[[العلم]] عمل"),
]


@pytest.mark.parametrize("q,text,snippet", SNIPPETS)
def test_snippets(spark, q, text, snippet):
    assert spans.build_snippet(text, q)["snippet"] == snippet
    row = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(udfs.build_snippet(F.col("t"), F.lit(q))["snippet"].alias("s")).collect()
    assert [r.s for r in row] == [snippet, None, None]


def test_snippets_of_hits(ranked):
    q = "طريق"
    assert all("[[طريق]]" in r.snippet for r in ranked.snippets(ranked.search(q, "page"), q).collect())


def test_spans_and_highlights():
    assert spans.normalized_spans("قُرْآن قران", "قران") == [(0, 6), (7, 11)]
    assert spans.highlight_normalized("a B ab", ["A", "b"], "all", "<", ">", 8) == "<a> <B> <a><b>"
    assert spans.highlight_normalized("a", ["a", "z"], "all", "<", ">", 8) is None
    assert spans.highlight_normalized("قال ﷺ", ["صلى"], "any", "<", ">", 8) == "قال <ﷺ>"
    assert spans.highlight_analyzed("المنصور باحث", ["منصور"], "any", "<", ">", 8) == "<المنصور> باحث"
    assert spans.highlight_analyzed("المنصور باحث", ["x"], "phrase", "<", ">", 8, ["باحث"]) == "المنصور <باحث>"
    with pytest.raises(ValueError):
        spans.highlight_normalized("a", ["a"], "some", "<", ">", 8)
    assert spans.select_spans_csv("0:5:1;3:9:0;20:25:1;22:30:1;bad;9:2:0") == "3:9;22:30" and spans.select_spans_csv(None) == ""
    assert spans.render_snippet("hello world", 6, 11, [(6, 8)]) == "…[[wo]]rld" and spans.render_snippet(None, 0, 1, []) == ""


def test_sql_functions(spark):
    names = udfs.register_all(spark)
    assert len(names) == 40 == len(set(names))
    one = lambda sql: spark.sql(f"SELECT {sql} AS x").first().x
    assert one("ar_analyze_json('الذين ملكت أيمانكم')") == json.dumps(["ملكت", "ايمانكم"], ensure_ascii=False) and one("ar_analyze_json(NULL)") == "[]"
    assert one("ar_normalize('قُرْآن', 0)") == "قُرْان" and one("ar_stem(NULL)") is None and one("ar_has_sensitive_forms(NULL, 1, 1, 1, 1)") == 0
    assert one("ar_levenshtein('قرآن', 'قران', 1)") == 1 and one("ar_levenshtein('abc', 'abcdef', 1)") == 2 and one("ar_wildcard_match('abc', 'a?d')") == 0
    assert one("ar_byte4_to_int(ar_int_to_byte4(1000))") == 984 and len(one("ar_norm_inverse_cache_blob(1.2, 0.75, 80)")) == 1024
    assert json.loads(one("ar_parse_query_ast_json(NULL)")) == {"clauses": []} and one("ar_parse_fuzzy_token_json('abc')") is None
    assert json.loads(one("ar_parse_boosted_token_clause_json('title:a*^2', 'title')")) == {"scope": "title", "raw": "a*", "boost": 2.0, "has_wildcard": True, "is_fuzzy": False}
    assert json.loads(one("""ar_parse_phrase_term_boolean_json('"a b"~2^3 OR c')"""))["shape"] == "phrase_term"
    assert one("ar_f32_add(0.1, 0.2)") == pytest.approx(0.3) and one("ar_lucene_term_score(0f, 1f, 5, 1.2f, 0.75f, 9f)") == 0


def test_table_function(spark):
    udfs.register_all(spark)
    rows = spark.sql("SELECT d.id, t.term, t.position FROM VALUES (1, 'The المنصور في box'), (2, NULL) AS d(id, text), LATERAL ar_tokens(d.text) t").collect()
    assert [(r.id, r.term, r.position) for r in rows] == [(1, "the", 0), (1, "منصور", 1), (1, "box", 3)]


def test_native_profile_and_one_call(engine):
    native = SearchOptions(profile="native")
    assert engine.compile("ص?ر", "page", native)["page"] == '(("مصور" OR "منصور"))' and engine.compile("ص?ر", "page")["page"] == '("__nohit__")'
    assert sorted(r["item_id"] for r in engine.search("المنصورة~1", "page", options=native).rows()) == [11, 12]
    found = json.loads(engine.execute_json("منصور", "page", 5, '{"allow_fuzzy": false}'))
    assert found["scores_are_f32"] and [h["item_id"] for h in found["hits"]] == [11]


def test_canonical_corpus(spark, tmp_path):
    item = (0, "", None)
    pages = spark.createDataFrame([(1, 7, 70, 1, *item), (2, 7, 71, 2, *item)], corpus.PAGE_MAP_SCHEMA)
    titles = spark.createDataFrame([(1, 7, 1, 1, None, *item), (2, 7, 2, 2, 1, *item), (3, 7, 3, 3, 2, *item), (4, 8, 4, 1, 99, *item), (5, 9, 5, 1, 6, *item), (6, 9, 6, 1, 5, *item)], corpus.TITLE_MAP_SCHEMA)
    bodies = spark.createDataFrame([(1, "a fox"), (2, "a box")], corpus.PAGE_STORE_SCHEMA)
    names = spark.createDataFrame([(1, "fox"), (2, "x"), (3, "y"), (4, "z")], corpus.TITLE_STORE_SCHEMA)
    found = Engine(build_index(corpus.docs_of(pages, bodies, titles, names), str(tmp_path / "i"))).search("fox", "both").rows()
    assert {(r["field"], r["book_id"], r["item_id"]) for r in found} == {("page", 7, 70), ("title", 7, 1)}
    assert {r.rowid: r.path for r in corpus.title_paths(titles).collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [4], 5: [6, 5], 6: [5, 6]}
    corpus.search_views(pages, titles)
    assert "source_sha1" not in spark.table("v_page_search_docs").columns


def test_readers(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"doc_id":"d1","page":"p","title":"t"}\n{"doc_id":"d2","page":"q"}\n')
    assert {(r.field, r.rowid, r.text) for r in readers.from_jsonl(readers.jsonl_documents(spark, str(tmp_path / "d.jsonl"))).collect()} == {("page", 1, "p"), ("title", 1, "t"), ("page", 2, "q")}
    (tmp_path / "b.tsv").write_text("x\t2YHYsQ==\ny\t!!\n")
    assert {r.id: r.text for r in readers.base64_texts(spark, str(tmp_path / "b.tsv")).collect()} == {"x": base64.b64decode("2YHYsQ==").decode(), "y": None}
    (tmp_path / "p.txt").write_text("1|2|a|b\nbad line\n3 | 4 | c\n")
    assert {(r.book_id, r.item_id, r.text) for r in readers.pipe_corpus(spark, str(tmp_path / "p.txt")).collect()} == {(1, 2, "a|b"), (3, 4, "c")}
    (tmp_path / "q.jsonl").write_text('{"id":"a","query":"x y","top_k":5}\n')
    assert readers.jsonl_queries(spark, str(tmp_path / "q.jsonl")).first().top_k == 5


def test_sinks(spark, tmp_path):
    held = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    assert {(r.k, r.v) for r in sinks.upsert(held, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C"), (None, "N")}
    run = spark.createDataFrame([("r", "smoke", "running")], "run_id string, tier string, status string")
    assert sinks.checked_runs(run).count() == 1
    with pytest.raises(Exception, match="isn't one of"):
        sinks.checked_runs(run.withColumn("tier", F.lit("other"))).collect()


def test_streaming_ingest_can_run_again(spark, tmp_path):
    source, target, checkpoint = (tmp_path / n for n in ("in", "out", "cp"))
    source.mkdir()

    def put(name, *rows):
        (source / name).write_text("".join(json.dumps(dict(zip(("field", "rowid", "book_id", "item_id", "text", "source_deleted"), r))) + "\n" for r in rows))

    def go():
        ingest.start(ingest.read_items(spark, str(source), files_at_once=1), str(target), str(checkpoint)).awaitTermination()

    put("1.json", ("page", 1, 1, 1, "the fox", 0), ("page", 2, 1, 2, "the box", 0))
    go()
    go()
    put("2.json", ("page", 1, 1, 1, "the fox", 0), ("page", 2, 1, 2, "a new box", 0), ("page", 3, 1, 3, "old", 0))
    go()
    put("3.json", ("page", 3, 1, 3, "old", 1))
    go()
    assert {(r.rowid, r.text) for r in ingest.current_items(spark, str(target)).collect()} == {(1, "the fox"), (2, "a new box")}
    terms = {(r.rowid, r.term) for r in ingest.current_postings(spark, str(target)).collect()}
    assert terms == {(1, "the"), (1, "fox"), (2, "a"), (2, "new"), (2, "box")}
    ingest.write_batch(str(target))(spark.createDataFrame([("page", 9, 1, 9, "nine", 0)], ingest.ITEM_SCHEMA), 7)
    ingest.write_batch(str(target))(spark.createDataFrame([("page", 9, 1, 9, "nine", 0)], ingest.ITEM_SCHEMA), 7)
    index = ingest.compact(spark, str(target), str(tmp_path / "index"))
    assert [r["item_id"] for r in Engine(index).search("nine", "page").rows()] == [9] and index.field_stats("page").item_count == 3


def test_command_line(engine, capsys):
    assert cli.main(["--index", engine.index.path, "--query", "منصور", "--field", "page", "--limit", "3"]) == 0
    printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert [h["item_id"] for h in printed["hits"]] == [11]
    options = cli.options_of(cli.parser().parse_args(["--index", "x", "--query", "y", "--respect-hamza-forms", "--disable-fuzzy-search"]))
    assert options.forms.letters is False and options.forms.hamza is False and options.allow_fuzzy is False
    assert "hits" in result_json(engine.search("منصور", "page"), "منصور", "page", options)


def test_catalogue_against_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "events", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in catalogue.ORACLE.items():
        got = catalogue.QUERIES[name](spark, folder)
        names = sorted(got.columns)
        want = db.execute(f"SELECT {', '.join(names)} FROM ({sql}) AS q").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*names).collect()), name


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["book_id", "item_id", "score"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_snippets_of_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    shown = {r.doc_id: r.snippet for r in catalogue.QUERIES["snippets"](spark, folder).collect()}
    assert shown == {i: spans.build_snippet(t, '"of the" OR that')["snippet"] for i, t in docs.items()}
