"""The analyser's rules, and the Column functions against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sahifa.functions import analyzer as A
from sahifa.functions import columns as C

TERMS = {
    "كبير": "كبير", "كبيرة": "كبير", "مشروبات": "مشروب", "أمريكيين": "امريك", "الكتاب": "كتاب", "الذين ملكت أيمانكم": "ملكت ايمانكم",
    "English text.": "english text", "١٢٣٤": "1234", "آجن": "اجن", "روبرـــــت": "روبرت", "ولداً": "لدا", "هٰ": "هٰ",
    "إ'لام الغرب": "ا'لام غرب", "EncycloPedique:قد بدأ": "encyclopedique:قد بدا", "ص٣٥٠،٣٥١": "ص350،351", "من٢litera": "من2litera",
    "1;2": "1;2", "١;٢": "1;2", "a1;2a": "a1;2a", "abc;20582": "abc 20582", "1؛2": "1 2", "٢١٨.91iDHbtNo.20920،٠٥٧٧٢٣": "218.91idhbtno 20920،057723",
    "رم÷اح": "رم اح", "abc­def": "abc def", "الرياض ̈الرابعة": "رياض رابع", "__ _": "", "": "", "إلتي التي": "تي", "É é": "É é",
}


@pytest.mark.parametrize("text,terms", TERMS.items())
def test_terms(text, terms):
    assert A.analyze(text) == terms.split()


def test_places():
    found = A.analyzer().tokens("المنصور في اللغة")
    assert [(t.term, t.offset, t.position, t.start, t.end) for t in found] == [("منصور", 0, 0, 0, 7), ("لغ", 1, 2, 11, 16)]
    assert [len(t) for t in A.analyze("a" * 600)] == [255, 255, 90]
    assert A.analyze(None) == []


def test_sentinels_take_an_offset_in_documents_only():
    text = "باب ـــ كتاب"
    assert [(t.term, t.offset, t.position) for t in A.analyzer().tokens(text, document=True)] == [("باب", 0, 0), (A.SENTINEL, 1, 1), ("كتاب", 2, 1)]
    assert A.analyze(text) == ["باب", "كتاب"]


def test_options():
    of = lambda *words: A.Analyzer(A.AnalyzerOptions.parse(*words))
    assert of("stopwords", "the", "stopwords=and, a").terms("The quick brown fox and a") == ["quick", "brown", "fox"]
    assert of("disable_stopwords").terms("في كتاب") == ["في", "كتاب"]
    assert of("stem_exclusion", "ساهدهات").terms("كبيرة the ساهدهات") == ["كبير", "the", "ساهدهات"]
    assert of("honorific_expansions").terms("قال ﷺ") == ["قال", *A.analyze("صلى الله عليه وسلم")]
    for bad in (["nonsense"], ["stopwords"], ["stem_exclusion"]):
        with pytest.raises(ValueError):
            A.AnalyzerOptions.parse(*bad)


def test_fuzz_is_the_same_each_time_and_keeps_places():
    rng = random.Random(99)
    letters = "ab1_.:;,'’ \nÉاأةىيـَُ٣٤،٫ﷺ̈中😀"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        found = A.analyzer().tokens(text, document=True)
        assert found == A.Analyzer().tokens(text, document=True)
        assert [t.offset for t in found] == list(range(len(found)))
        assert all(0 <= t.start < t.end <= len(text) and t.term for t in found)
        assert [t.start for t in found] == sorted(t.start for t in found)


def values(spark, data, schema, **out):
    return spark.createDataFrame(data, schema).select(*[c.alias(n) for n, c in out.items()]).collect()


def test_columns_are_the_python_functions(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("اأآإةىيهوالبكفنتـَab٣۴9*") for _ in range(rng.randrange(9))) for _ in range(300)] + [None]
    rows = values(spark, [(w,) for w in words], "w string", n=C.normalize(F.col("w"), lower=True), s=C.stem(F.col("w")), f=C.has_sensitive_forms(F.col("w"), C.Forms(digits=False, hamza=False)))
    for w, r in zip(words, rows):
        assert r.n == (None if w is None else C.normalize_text(w, lower=True))
        assert r.s == (None if w is None else A.stem(w))
        assert r.f == (w is not None and C.text_is_sensitive(w, C.Forms(digits=False, hamza=False)))


def encode(n):
    def int4(v):
        bits = v.bit_length()
        return v if bits < 4 else ((v >> (bits - 4)) & 7) | ((bits - 3) << 3)

    return n if n < 24 else 24 + int4(n - 24)


def test_lengths_as_bytes(spark):
    data = [*range(300), *(2**k + d for k in range(9, 31) for d in (-1, 0, 1)), 2**31 - 1]
    rows = values(spark, [(n,) for n in data], "n long", code=C.int_to_byte4(F.col("n")), kept=C.quantised(F.col("n")), back=C.byte4_to_int(C.int_to_byte4(F.col("n"))))
    for n, r in zip(data, rows):
        assert r.code == encode(n) and r.kept <= n and encode(r.kept) == r.code and r.back == r.kept
    for bad in (C.int_to_byte4(F.lit(-1).cast("long")), C.byte4_to_int(F.lit(256))):
        with pytest.raises(Exception, match="byte|negative"):
            spark.range(1).select(bad).collect()


def test_scores_are_single_precision(spark):
    f = np.float32
    data = [(w, tf, n) for w in (0.1, -0.7, 2.5) for tf in (1, 3, 40) for n in (0, 7, 100, 5000)]
    by_value, by_column = (values(spark, data, "w double, tf int, n long", s=C.term_score(F.col("w"), F.col("tf"), F.col("n"), avg)) for avg in (123.4, F.lit(123.4)))
    kept = dict(zip([0, 7, 100, 5000], [r.k for r in values(spark, [(0,), (7,), (100,), (5000,)], "n long", k=C.quantised(F.col("n")))]))
    for (w, tf, n), a, b in zip(data, by_value, by_column):
        norm = f(1) / (f(1.2) * ((f(1) - f(0.75)) + f(0.75) * f(kept[n]) / f(123.4)))
        assert a.s == b.s == float(f(w) - f(w) / (f(1) + f(tf) * norm))
    assert spark.range(1).select(C.idf(1, 2).alias("x")).first().x == float(f(np.log(1 + (1 - 2 + 0.5) / 2.5)))


def chains(places, gaps, slop):
    def go(k, first, last):
        if k == len(places):
            return 1
        return sum(go(k + 1, first if k else p, p) for p in places[k] if p > last and (not k or p - first - gaps[k] <= slop))

    return go(0, None, -1)


def test_phrase_frequency(spark):
    rng = random.Random(3)
    for n in (2, 3, 4):
        data = [([sorted(rng.sample(range(25), rng.randrange(1, 9))) for _ in range(n)],) for _ in range(25)]
        for slop in (0, 2, 5):
            gaps = [0, *sorted(rng.sample(range(1, 6), n - 1))]
            rows = values(spark, data, "p array<array<int>>", x=C.phrase_frequency([F.col("p")[i] for i in range(n)], gaps, slop))
            assert [r.x for r in rows] == [chains(p, gaps, slop) for (p,) in data]


def test_places_are_those_of_the_tokens():
    rng = random.Random(12)
    letters = "اأإلوهيةىنتفكًـ٣ 7aB_.:'’;,،é "
    for options in (A.AnalyzerOptions(), A.AnalyzerOptions.parse("stopwords", "a,في", "honorific_expansions")):
        own = A.Analyzer(options)
        for text in [None, "", "ـ a ﷺ في", *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500))]:
            want = {}
            for t in own.tokens(text, document=True):
                o, p = want.setdefault(t.term, ([], []))
                o.append(t.offset)
                p += [t.position] * (t.term != A.SENTINEL)
            assert own.places(text) == want
