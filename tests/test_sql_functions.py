"""The SQL functions over built-ins against plain Python, on random and awkward arguments."""

import json
import random
import re

import pytest

from sahifa.functions import spans, udfs
from sahifa.functions.analyzer import stem
from sahifa.functions.columns import Forms, normalize_text, text_is_sensitive, wildcard_regex

LETTERS = "اأإآىةيهوبلكفنتًُـ٣۴7aBz *?.:-\\'\"[](){}^$+|_،"


@pytest.fixture(scope="module")
def sql(spark):
    udfs.register_all(spark)

    def run(call, names, rows):
        spark.createDataFrame(rows, names).createOrReplaceTempView("arguments")
        return [r.x for r in spark.sql(f"SELECT {call} AS x, n FROM arguments ORDER BY n").collect()]

    return run


def texts(rng, n, most=12):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(most))) for _ in range(n)] + [None, ""]


def test_normalize(sql):
    rng = random.Random(1)
    rows = [(n, t, *(rng.choice([0, 1, None]) for _ in range(5))) for n, t in enumerate(texts(rng, 300))]
    found = sql("ar_normalize(t, d, h, l, g, low)", "n int, t string, d int, h int, l int, g int, low int", rows)
    for x, (_, t, *flags) in zip(found, rows):
        d, h, l, g, low = (bool(default if f is None else f) for f, default in zip(flags, (1, 1, 1, 1, 0)))
        assert x == (None if t is None else normalize_text(t, Forms(d, h, l, g), low))
    assert sql("ar_normalize(t)", "n int, t string", [r[:2] for r in rows]) == [None if t is None else normalize_text(t) for _, t, *_ in rows]


def test_stem_and_sensitive_forms(sql):
    rng = random.Random(2)
    words = [None, "", "ال", *("".join(rng.choice("الوبكفهانتيةه") for _ in range(rng.randrange(1, 9))) for _ in range(500))]
    assert sql("ar_stem(t)", "n int, t string", list(enumerate(words))) == [None if w is None else stem(w) for w in words]
    rows = [(n, t, *(rng.choice([0, 1, None]) for _ in range(4))) for n, t in enumerate(texts(rng, 300, 5))]
    found = sql("ar_has_sensitive_forms(t, d, h, l, g)", "n int, t string, d int, h int, l int, g int", rows)
    assert found == [int(bool(t) and text_is_sensitive(t, Forms(*(not f for f in flags)))) for _, t, *flags in rows]


def test_wildcard_match(sql):
    rng = random.Random(3)
    patterns = ["".join(rng.choice("ab*?.\\[(+é_ -") for _ in range(rng.randrange(5))) for _ in range(400)] + [None]
    rows = [(n, "".join(rng.choice("ab.\\[(+é_ -") for _ in range(8)), p) for n, p in enumerate(patterns)] + [(999, None, "a")]
    want = [None if None in (t, p) else int(re.search(wildcard_regex(p, False), t) is not None) for _, t, p in rows]
    assert sql("ar_wildcard_match(t, p)", "n int, t string, p string", rows) == want


def test_select_spans(sql):
    rng = random.Random(4)
    items = lambda: ";".join(rng.choice(["%d:%d:%d" % (s := rng.randrange(20), s + rng.randrange(-1, 8), rng.randrange(3)), "bad", "1:2", "+3: 9:-1", "1:99999999999:1", ""]) for _ in range(rng.randrange(9)))
    rows = [(n, items()) for n in range(300)] + [(999, None)]
    assert sql("ar_select_non_overlapping_spans_csv(t)", "n int, t string", rows) == [spans.select_spans_csv(t) for _, t in rows]


def test_snap_window(sql):
    rng = random.Random(5)
    rows = [(n, t, rng.choice([None, *range(-3, 30)]), rng.choice([None, *range(-3, 30)]), rng.choice([None, -1, 0, 2, 12])) for n, t in enumerate(texts(rng, 400, 25))]
    want = [json.dumps(dict(zip(("start", "end"), spans.snap_window(t, s or 0, e or 0, 12 if k is None else k)))) for _, t, s, e, k in rows]
    assert sql("ar_snap_snippet_window_json(t, s, e, k)", "n int, t string, s int, e int, k int", rows) == want
    assert sql("ar_snap_snippet_window_json(t, s, e)", "n int, t string, s int, e int", [r[:4] for r in rows])[:5] == [json.dumps(dict(zip(("start", "end"), spans.snap_window(t, s or 0, e or 0)))) for _, t, s, e, _ in rows[:5]]
