"""The strict filter: hits must also match the query's literals in the spellings that aren't ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns
from ..functions.analyzer import analyze
from ..functions.columns import Forms
from ..plans import syntax
from ..plans.syntax import MUST, MUST_NOT, Leaf


@dataclass
class Literal:
    text: str
    is_pattern: bool
    required: bool
    prohibited: bool


def _of(leaf: Leaf, occur: str, field: str) -> list[Literal]:
    flags = (occur == MUST, occur == MUST_NOT)
    if group := syntax.field_group(leaf):
        if group[0] != field:
            return []
        return [x for inner, o in syntax.leaves(group[1]) for x in _of(inner, syntax.compose(occur, o), field)]
    if phrase := syntax.phrase_of(leaf):
        scope, text, _ = phrase
        return [Literal(text, False, *flags)] if scope in (None, field) and text.strip() else []
    token = leaf.value
    if not token or token.upper() in syntax.OPERATORS or token in "()":
        return []
    scope, raw = syntax.scoped(token)
    if scope not in (None, field):
        return []
    raw, _ = syntax.strip_boost(raw)
    if not raw:
        return []
    if fuzzy := syntax.fuzzy(raw):
        return [Literal(fuzzy[0], False, *flags)] if fuzzy[0].strip() else []
    if syntax.has_wildcard(raw):
        return [Literal(raw, True, *flags)] if raw.strip("*?") else []
    return [Literal(raw, False, *flags)] if analyze(raw) else []


def literals(q: str, field: str) -> list[Literal]:
    """The literals of a query in a field; a single optional one is required."""
    out = [x for leaf, occur in syntax.leaves(q) for x in _of(leaf, occur, field)]
    positive = [x for x in out if not x.prohibited]
    if len(positive) == 1:
        positive[0].required = True
    return out


def present(text: Column, literal: Literal, forms: Forms) -> Column:
    """Whether a text has the literal, in the spellings that count."""
    wanted = columns.normalize_text(literal.text, forms, lower=True).strip()
    body = columns.normalize(text, forms, lower=True)
    if not wanted:
        return F.lit(True)
    return columns.wildcard_match(body, wanted) if literal.is_pattern else F.contains(body, F.lit(wanted))


def literal_match(text: Column, literal: Literal, forms: Forms) -> Column:
    """The same, but a literal without such spellings always matches."""
    return present(text, literal, forms) if columns.text_is_sensitive(literal.text, forms) else F.lit(True)


def strict_filter(text: Column, q: str, field: str, forms: Forms) -> Column:
    """Which hits of this field stay, by their text."""
    found = literals(q, field) if forms.strict else []
    sensitive = [x for x in found if columns.text_is_sensitive(x.text, forms)]
    text = F.coalesce(text, F.lit(""))
    out = F.lit(True)
    for x in sensitive:
        if x.prohibited:
            out = out & ~present(text, x, forms)
    required = [x for x in sensitive if x.required and not x.prohibited]
    for x in required:
        out = out & present(text, x, forms)
    optional = [x for x in sensitive if not x.required and not x.prohibited]
    if optional and not required:
        plain = [x for x in found if not x.required and not x.prohibited and x not in sensitive]
        some = F.lit(False)
        for x in plain + optional:
            some = some | present(text, x, forms)
        out = out & some
    return out
