"""Python workers take a batch a piece at a time: what they hold doesn't follow the rows and texts of a batch."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.udf import UDFRegistration

from sahifa.functions import spans, udfs
from sahifa.functions.analyzer import KEPT_LENGTH, Analyzer, analyze, analyzer
from sahifa.operators.index import postings_of, tokens_of
from sahifa.sources.pieces import PIECE_BYTES, PIECE_ROWS, bounds

TEXTS = [f"of the n{i} that {'the way ' * 40}" for i in range(6000)] + [None, "", "x " * PIECE_BYTES, "last"]


class Docs:
    """Stands for a DataFrame: gives the function that would run over its batches."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def batch(names):
    n = len(TEXTS)
    columns = {"field": pa.array(["page"] * n), **{c: pa.array(range(n), pa.int64()) for c in ("rowid", "book_id", "item_id")}, "text": pa.array(TEXTS)}
    return pa.RecordBatch.from_pydict({c: columns[c] for c in names})


def test_bounds():
    found = list(bounds([pa.array(TEXTS)]))
    assert [a for a, _ in found] == [0, *(b for _, b in found[:-1])] and found[-1][1] == len(TEXTS)
    assert all(b - a == 1 or sum(len(t or "") for t in TEXTS[a:b]) <= PIECE_BYTES for a, b in found)
    assert list(bounds([pa.array([], pa.string())])) == [(0, 0)]
    assert [b - a for a, b in bounds([pa.array([1] * 5000), pa.array([None] * 5000, pa.string())])] == [PIECE_ROWS, PIECE_ROWS, 5000 - 2 * PIECE_ROWS]


def test_tokens_come_a_piece_at_a_time(spark):
    out = list(tokens_of(Docs(spark))(iter([batch(["field", "rowid", "text"])])))
    rows = pa.Table.from_batches(out)
    assert rows["term"].to_pylist() == [t for text in TEXTS for t in analyze(text)]
    # The long text is a piece of its own.
    assert len(out) > 3 and sorted(b.num_rows for b in out)[-2] < 0.3 * rows.num_rows


def test_postings_come_a_piece_at_a_time(spark):
    out = list(postings_of(Docs(spark))(iter([batch(["field", "rowid", "book_id", "item_id", "text"])])))
    rows = pa.Table.from_batches(out)
    want = [(i, term, *places) for i, text in enumerate(TEXTS) for term, places in analyzer().places(text).items()]
    assert list(zip(*(rows[c].to_pylist() for c in ("rowid", "term", "offsets", "positions")))) == want
    assert len(out) > 3 and max(b.num_rows for b in out) < 0.5 * rows.num_rows


def _run(made, *columns):
    """What a UDF makes of one batch: the sizes of its pieces, and the values."""
    out = list(made.func(iter([columns if len(columns) > 1 else columns[0]])))
    assert max(map(len, out)) < 0.5 * len(TEXTS)
    return [x for piece in out for x in piece.to_pylist()]


@pytest.mark.parametrize("function, literals, want", [
    (udfs.normalized_spans, ("way", 2**31 - 1), lambda t: [{"start": s, "end": e} for s, e in spans.normalized_spans(t, "way", 2**31 - 1)]),
    (udfs.highlight_analyzed, (["way"], "any", "<", ">", 9, None), lambda t: spans.highlight_analyzed(t, ["way"], "any", "<", ">", 9)),
    (udfs.build_snippet, ('"of the" OR that',), lambda t: spans.build_snippet(t, '"of the" OR that')),
])
def test_functions_give_a_piece_at_a_time(spark, function, literals, want):
    function(*[F.lit(None)] * (1 + len(literals)))
    found = _run(function.made, pa.array(TEXTS), *(pa.array([x] * len(TEXTS)) for x in literals))
    assert found == list(map(want, TEXTS))


def test_sql_functions_give_a_piece_at_a_time(spark, monkeypatch):
    made = {}
    with monkeypatch.context() as m:
        m.setattr(UDFRegistration, "register", lambda self, name, f, *_: made.__setitem__(name, f))
        udfs.register_all(spark)
    assert _run(made["ar_analyze_json"], pa.array(TEXTS)) == [json.dumps(analyze(t), ensure_ascii=False) for t in TEXTS]
    want = [json.dumps([{"term": x.term, "position": x.position} for x in analyzer().tokens(t)], ensure_ascii=False) for t in TEXTS]
    assert _run(made["ar_analyze_positions_json"], pa.array(TEXTS)) == want


def test_functions_within_functions(spark):
    udfs.register_all(spark)
    rows = spark.createDataFrame([(t,) for t in TEXTS[-30:]], "t string").repartition(2)
    found = rows.selectExpr("t", "ar_analyze_json(ar_analyze_json(t)) AS twice", "ar_analyze_positions_json(t) AS places", "ar_find_all_normalized_match_spans_json(t, 'way') AS way", "ar_find_all_normalized_match_spans_json(t, 'way', 2) AS two").collect()
    for r in found:
        assert r.twice == json.dumps(analyze(json.dumps(analyze(r.t), ensure_ascii=False)), ensure_ascii=False)
        assert [len(json.loads(x)) for x in (r.way, r.two)] == [len(spans.normalized_spans(r.t, "way", n)) for n in (8, 2)]
    assert rows.where("false").selectExpr("ar_analyze_json(t)").collect() == []


def test_long_tokens_are_not_kept():
    own, long = Analyzer(), "a" * (KEPT_LENGTH + 1)
    assert [t.term for t in own.tokens(f"{long} b")] == [long, "b"] and list(own.places(f"{long} b")) == [long, "b"]
    assert list(own.kept) == list(own.stretches) == ["b"]
