"""Many texts analysed at once give what each gives alone; many queries at once are sent to the postings."""

import random

import pytest

from sahifa.engine import Engine
from sahifa.functions.analyzer import DEFAULT, Analyzer, AnalyzerOptions
from sahifa.operators.index import build_index

LETTERS = "اأإآىةيهوبلكفنتًُـ٣۴7aBz .:-'_،;ﷺ" + chr(0x85)


@pytest.mark.parametrize("options", [DEFAULT, AnalyzerOptions(honorifics=True), AnalyzerOptions(stop_words=frozenset({"ab", "و"}))])
def test_places_of_many_texts(options):
    rng = random.Random(3)
    for _ in range(200):
        texts = [rng.choice([None, "", "ـ", "في ـ من", "x" * 300]) if rng.random() < 0.2 else "".join(rng.choices(LETTERS, k=rng.randrange(80))) for _ in range(rng.randrange(7))]
        want = [(i, term, *places) for i, text in enumerate(texts) for term, places in Analyzer(options).places(text).items()]
        text_of, terms, term, *lists = Analyzer(options).places_of(texts)
        each = ([values[a:b].tolist() for a, b in zip(ends, ends[1:])] for values, ends in lists)
        assert list(zip(text_of.tolist(), [terms[t] for t in term], *each)) == want


def test_batch_terms_are_not_shuffled_by_term(spark, tmp_path):
    docs = spark.createDataFrame([("page", i, i % 3, i, f"that with {'that ' * (i % 5)}") for i in range(50)], "field string, rowid long, book_id long, item_id long, text string")
    engine = Engine(build_index(docs, str(tmp_path / "index")))
    found = engine.batch_terms({"a": "that", "b": "with", "c": "that"}, "page", 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "SortMergeJoin" not in plan
    rows = sorted(map(tuple, found.collect()))
    assert [r[0] for r in rows] == ["a"] * 4 + ["b"] * 4 + ["c"] * 4
    assert [r[1:] for r in rows[:4]] == [r[1:] for r in rows[8:]]
