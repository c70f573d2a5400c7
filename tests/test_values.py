"""Values that fix the query language: trees, errors, expressions, expansions, strictness and snippets.

Trees are written in short: + must, - must not, [ ] a group, kind<value> a leaf.
"""

import pytest

from sahifa.engine import Engine, SearchOptions
from sahifa.functions import spans
from sahifa.functions.columns import Forms, normalize_text, text_is_sensitive
from sahifa.operators.index import DOC_SCHEMA, build_index
from sahifa.operators.strict import Literal, literal_match
from sahifa.plans import syntax
from sahifa.plans.syntax import Group, QueryError
from pyspark.sql import functions as F

TREES = {
    'المنصور^2': 'token<المنصور^2>',
    'title:(المنصور^3 OR المصور) AND باب': '+field_group<title\tالمنصور^3 OR المصور> +token<باب>',
    'منسور~1': 'token<منسور~1>',
    'منسور~1^2': 'token<منسور~1^2>',
    'م*ور': 'token<م*ور>',
    'م*ور^3': 'token<م*ور^3>',
    '+title:(المنصور OR المصور)^2': '+field_group_boost<title\t2\tالمنصور OR المصور>',
    'title:المصور^3 OR المصور': 'token<title:المصور^3> token<المصور>',
    'title:المصور^3 OR page:المنصور': 'token<title:المصور^3> token<page:المنصور>',
    '-(المصور OR مزور) AND منصور': '-[token<المصور> token<مزور>] +token<منصور>',
    '"طريق العلم"~2': 'phrase_slop<2\tطريق العلم>',
    'المنصور^2 OR المصور': 'token<المنصور^2> token<المصور>',
    'title:("باب المنصور" OR "باب المصور")': 'field_group<title\t"باب المنصور" OR "باب المصور">',
    '(المنصور OR المصور) AND (باحث OR باب)': '+[token<المنصور> token<المصور>] +[token<باحث> token<باب>]',
    'title:(المنصور OR المصور)^2 AND page:بارع': '+field_group_boost<title\t2\tالمنصور OR المصور> +token<page:بارع>',
    '"\\"طريق العلم\\""': 'phrase<"طريق العلم">',
    '"\\"طريق العلم\\""^2 OR المصور': 'phrase<"طريق العلم"> token<المصور>',
    'title:"\\"باب المصور\\""': 'field_phrase<title:"باب المصور">',
    'title:"\\"باب المصور\\""^2': 'field_phrase<title:"باب المصور">',
    '("\\"طريق العلم\\""^4 OR "\\"طريق الادب\\"") AND نافع': '+[phrase<"طريق العلم"> phrase<"طريق الادب">] +token<نافع>',
    'title:("\\"باب المنصور\\"" OR "\\"باب المصور\\"")': 'field_group<title\t"\\"باب المنصور\\"" OR "\\"باب المصور\\"">',
    '(المنصور OR المصور)^2': '[token<المنصور> token<المصور>]',
    '(الكاتب^3 OR الشاعر) AND بارع': '+[token<الكاتب^3> token<الشاعر>] +token<بارع>',
    '((الكاتب^3 OR الشاعر) AND بارع)^2': '[+[token<الكاتب^3> token<الشاعر>] +token<بارع>]',
    '"طريق العلم"^4 OR "طريق الادب"': 'phrase<طريق العلم> phrase<طريق الادب>',
    '("طريق العلم"^4 OR "طريق الادب") AND نافع': '+[phrase<طريق العلم> phrase<طريق الادب>] +token<نافع>',
    'title:(المنصور^3 OR المصور)': 'field_group<title\tالمنصور^3 OR المصور>',
    '(title:(المنصور^3 OR المصور))^2': '[field_group<title\tالمنصور^3 OR المصور>]',
    'الصلاة': 'token<الصلاة>',
    '"صلى الله"': 'phrase<صلى الله>',
    'الله AND الحديث': '+token<الله> +token<الحديث>',
    'الزكاه': 'token<الزكاه>',
    'ايمان': 'token<ايمان>',
    'الدُّعَاء': 'token<الدُّعَاء>',
    'الهدي': 'token<الهدي>',
    'الفتي': 'token<الفتي>',
    'title:الزكاه': 'token<title:الزكاه>',
    '"قراءة الكتاب"': 'phrase<قراءة الكتاب>',
    'title:"\\"باب القراءة\\""^2 OR المصور': 'field_phrase<title:"باب القراءة"> token<المصور>',
    'وسائل الدعوة': 'token<وسائل> token<الدعوة>',
    'مسؤوليه OR مسؤولية': 'token<مسؤوليه> token<مسؤولية>',
    '123^5 OR ١٢٣': 'token<123^5> token<١٢٣>',
    '"العلم نور" OR العلم': 'phrase<العلم نور> token<العلم>',
    'title:"باب القراءة" OR page:المدرسه': 'field_phrase<title:باب القراءة> token<page:المدرسه>',
    '"الكاتب"^3 AND العلم': '+phrase<الكاتب> +token<العلم>',
}
INVALID = {
    'title:(المنصور)^1.2.3': 'invalid group boost',
    '(المنصور OR المصور)^1.2.3': 'invalid group boost',
    '(المنصور OR المصور)^': 'invalid group boost',
    'title:(المنصور OR المصور': 'unclosed field-group parentheses in query',
    'AND المصور': 'dangling boolean operator',
    'المنصور AND': 'dangling boolean operator',
    'المنصور AND OR المصور': 'consecutive boolean operators',
    'NOT': 'dangling NOT modifier',
    '+': 'dangling + modifier',
    '-': 'dangling - modifier',
    '+ AND المصور': 'dangling clause modifier before boolean operator',
    '(المنصور OR المصور': 'unclosed group in query',
    ') المصور': 'unmatched closing parenthesis',
}


def shown(clauses):
    mark = {"MUST": "+", "MUST_NOT": "-", "SHOULD": ""}
    return " ".join(mark[c.occur] + (f"[{shown(c.node.clauses)}]" if isinstance(c.node, Group) else f"{c.node.kind}<{c.node.value}>") for c in clauses)


@pytest.mark.parametrize("q,tree", TREES.items())
def test_trees(q, tree):
    assert shown(syntax.parse(q)) == tree


@pytest.mark.parametrize("q,message", INVALID.items())
def test_invalid_queries(q, message):
    with pytest.raises(QueryError, match=message.replace("(", "\\(").replace(")", "\\)").replace("+", "\\+")):
        syntax.parse(q)


PAGES = ["المنصور باحث في اللغة", "المصور يكتب المقال", "قُرْآن وإيمان ١٢٣", "قران وايمان 123", "المنصور مزور", "منصور متقدم", "مصور ماهر"]
TITLES = ["باب المنصور", "باب المصور", "مدخل اللغة"]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    rows = [(field, n, 10, base + n, t) for field, base, texts in (("page", 10, PAGES), ("title", 20, TITLES)) for n, t in enumerate(texts, 1)]
    return Engine(build_index(spark.createDataFrame(rows, DOC_SCHEMA), str(tmp_path_factory.mktemp("g") / "x")))


#: Query, lenient or not, and its expression in page, in title, or its error.
EXPRESSIONS = [
    ('المنصور', False, '("المنصور")', '("المنصور")'),
    ('المنصور AND المصور', False, '("المنصور") AND ("المصور")', '("المنصور") AND ("المصور")'),
    ('"المنصور في اللغة"', False, '(NEAR("منصور" "لغ", 1))', None),
    ('"المنصور في اللغة"~2', False, '(NEAR("منصور" "لغ", 3))', None),
    ('page:المنصور', False, '("المنصور")', '("__nohit__")'),
    ('title:المنصور', False, '("__nohit__")', '("المنصور")'),
    ('page:(المنصور OR المصور)', False, '("المنصور") OR ("المصور")', '("__nohit__")'),
    ('title:(المنصور OR المصور)^2', False, '("__nohit__")', '("المنصور") OR ("المصور")'),
    ('+المنصور -مزور', False, '(("المنصور")) NOT (("مزور"))', None),
    ('(المنصور OR المصور) AND اللغة', False, '(("المنصور") OR ("المصور")) AND ("اللغة")', None),
    ('قُرْآن', False, '("قُرْآن")', None),
    ('قران', False, '("قران")', None),
    ('منص*', False, '("منص"*)', None),
    ('*صور', False, '(("مصور" OR "منصور"))', None),
    ('م*ور', False, '(("مزور" OR "مصور" OR "منصور"))', None),
    ('منصور~1', False, '(("مصور" OR "منصور"))', None),
    ('title:', False, QueryError('dangling field scope'), None),
    ('"غير مغلق', False, QueryError('unclosed quote in query'), None),
    ('title:', True, '"__nohit__"', '"__nohit__"'),
]


@pytest.mark.parametrize("q,lenient,page,title", EXPRESSIONS)
def test_expressions(engine, q, lenient, page, title):
    options = SearchOptions(lenient=lenient)
    if isinstance(page, QueryError):
        with pytest.raises(QueryError, match=str(page)):
            engine.compile(q, "both", options)
        return
    found = engine.compile(q, "both", options)
    assert found["page"] == page and title in (None, found["title"])


def test_expansions(engine):
    index = engine.index
    assert index.expand_pattern("page", "*صور", 10) == ["مصور", "منصور"] and index.expand_pattern("page", "منص*", 10) == ["منصور"]
    assert index.expand_pattern("page", "م*ور", 10) == ["مزور", "مصور", "منصور"]
    assert index.expand_fuzzy("page", "منصور", 1, 10) == ["مصور", "منصور"] and index.expand_fuzzy("page", "قران", 1, 10) == []
    assert normalize_text("*قُر?آن*") == "*قر?ان*"


def test_strict_literals(spark):
    marks, hamza = Forms(diacritics=False), Forms(hamza=False)
    assert text_is_sensitive("قُرْآن", marks) and not text_is_sensitive("قران", marks)
    cases = [("قُرْآن كريم", "قُرْآن", marks, True), ("قران كريم", "قُرْآن", marks, False), ("ايمان قوي", "إيمان", hamza, False)]
    for text, literal, forms, want in cases:
        row = spark.createDataFrame([(text,)], "t string").select(literal_match(F.col("t"), Literal(literal, False, True, False), forms).alias("x")).first()
        assert row.x == want


SNIPPETS = [
    ('title:"باب القراءة"', 'لا يوجد هنا تطابق واضح.', 'باب القراءة في العلم', 'title', '[[باب القراءة]] في العلم'),
    ('123^5 OR ١٢٣', 'رقم ١٢٣ ورقم 123 متساويان', 'الأرقام العربية', 'page', '[[ر]]قم ١٢٣ ورقم 123 متساويان'),
    ('title:"باب القراءة" OR page:المدرسه', 'قراءة الكتاب نافعه في المدرسه', 'باب القراه', 'page', 'قراءة الكتاب نافعه في [[المدرسه]]'),
    ('title:"\\"باب القراءة\\""^2 OR المصور', 'المصور باحث بارع', 'فن المصور', 'page', '[[المصور]] باحث بارع'),
]


@pytest.mark.parametrize("q,page,title,field,snippet", SNIPPETS)
def test_field_snippets(q, page, title, field, snippet):
    assert spans.best_field_snippet(page, title, q) == (field, snippet)
