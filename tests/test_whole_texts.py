"""The queries of the index over texts of all scripts, against a brute-force count of the analyser's tokens."""

from collections import Counter, defaultdict

import pytest

from sahifa import catalogue
from sahifa.functions.analyzer import SENTINEL, analyze, analyzer

TEXTS = {1: "The thing of the 3 thinkers, in 2024", 2: "قُرْآن وإيمان ١٢٣ that Größe42", 3: "Это всё that это 123 with", 4: "هذا المنصور with the naïve thing of the day", 5: "", 6: "!!", 7: "ـ that x1y2 that", 8: None}
TITLES = {1: "The 1st", 2: "مدرسة 7", 3: "the the"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    docs = [(i, t, f"source{i % 3}") for i, t in TEXTS.items()]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    pages = [(i, f"<html><title>{t}</title></html>") for i, t in TITLES.items()]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return str(path)


def rows(spark, folder, name):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, folder).collect()]


def test_all_queries_but_one_have_sql():
    assert [n for n in catalogue.QUERIES if n not in catalogue.ORACLE] == ["snippets"]


def test_index_of_whole_texts(spark, folder):
    tokens = {i: analyzer().tokens(t, document=True) for i, t in TEXTS.items()}
    offsets, docs, counts, books = defaultdict(list), Counter(), Counter(), Counter()
    for i, found in tokens.items():
        books[i % 3] += len(found)
        for t in found:
            offsets[t.term, i].append(t.offset)
    for (term, _), o in offsets.items():
        docs[term] += 1
        counts[term] += len(o)
    assert {"123", "3", "2024"} <= set(counts) and any(ord(c) > 127 for t in counts for c in t)
    assert sorted(rows(spark, folder, "postings")) == sorted((t, i, len(o), min(o), max(o), sum(o)) for (t, i), o in offsets.items())
    words = sorted((t, docs[t], n) for t, n in counts.items() if t != SENTINEL)
    assert sorted(rows(spark, folder, "vocabulary")) == words
    assert sorted(rows(spark, folder, "tokens_count")) == sorted((i, i % 3, len(f)) for i, f in tokens.items() if f)
    assert sorted(rows(spark, folder, "book_lengths")) == sorted(books.items())
    assert rows(spark, folder, "field_stats") == [("page", len(books), len(TEXTS), sum(books.values()))]
    assert [t for (t,) in rows(spark, folder, "prefix_terms")] == [t for t, _, _ in words if t.startswith("thin")]


def test_hits_of_whole_texts(spark, folder):
    terms = {i: analyze(t) for i, t in TEXTS.items()}
    has = lambda *wanted: {i for i, own in terms.items() if all(w in own for w in wanted)}
    assert {i for _, i, _ in rows(spark, folder, "bm25_single_term")} == has("the")
    assert {i for _, i, _ in rows(spark, folder, "bm25_and")} == has("that", "with")
    assert {i for (i,) in rows(spark, folder, "match_not")} == has("the") - has("that")


def test_spans_of_whole_texts(spark, tmp_path):
    text = "that x with " * 20
    spark.createDataFrame([(1, text, "source1")], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    at = lambda word: {(i, i + 4) for i in range(len(text)) if text[i : i + 4] == word}
    assert {r[2:] for r in rows(spark, tmp_path, "normalized_spans")} == at("that")
    assert {r[2:] for r in rows(spark, tmp_path, "analyzed_spans")} == at("that") | at("with")
    assert rows(spark, tmp_path, "highlight_all") == [(1, text.replace("that", "<b>that</b>").replace("with", "<b>with</b>"))]


def test_the_token_pattern_is_the_analyser():
    """What SQL takes for tokens are the analyser's, on texts without Arabic that try every rule."""
    import random

    duckdb = pytest.importorskip("duckdb")
    db, rng = duckdb.connect(), random.Random(2)
    texts = ["".join(rng.choice("aB1_.':;,’é ñ2-") for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    found = db.execute(f"SELECT {catalogue._words('text')} FROM (SELECT unnest(?) AS text)", [texts]).fetchall()
    assert [w for (w,) in found] == [analyze(t) for t in texts]
