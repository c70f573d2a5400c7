"""Places of matches in a text, highlights and snippets. Plain Python on one text; `udfs` runs it on the hits that are shown.

Places are code points of the text as it is, ends exclusive.
"""

from __future__ import annotations

import re

from ..plans import syntax
from ..plans.syntax import Group, Leaf, QueryError
from .analyzer import HONORIFICS, SENTINEL, analyze, analyzer
from .columns import RELAXED, normalize_text, translation

Span = tuple[int, int]
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BREAKS = frozenset(" \t\n\v\f\r`~!@#$%^&*()-_=+[{]}\\|;:'\",<.>/?،؛«»…")
MODES = ("any", "all", "phrase")
AROUND, SCAN, PER_TERM = 24, 12, 8


def relaxed(text: str) -> str:
    return normalize_text(text, RELAXED, lower=True)


_GONE = frozenset(chr(c) for c, to in translation(RELAXED, True).items() if to is None)
_GLYPH = re.compile(f"[{''.join(HONORIFICS)}]")


def relaxed_with_places(text: str) -> tuple[str, list[int] | range]:
    """The text in relaxed spelling, and each remaining character's place."""
    body = relaxed(text)
    if len(body) == len(text):
        return body, range(len(text))
    return body, [i for i, c in enumerate(text) if c not in _GONE]


def normalized_spans(text: str | None, term: str | None, limit: int = PER_TERM) -> list[Span]:
    """Where a term occurs in relaxed spelling, from the left, without overlaps."""
    wanted = relaxed(term or "")
    if not text or not wanted or limit <= 0:
        return []
    body, place = relaxed_with_places(text)
    out, at = [], body.find(wanted)
    while at >= 0 and len(out) < limit:
        out.append((place[at], place[at + len(wanted) - 1] + 1))
        at = body.find(wanted, at + len(wanted))
    return out


def _display_spans(text: str, term: str, limit: int) -> list[Span]:
    """The same, and the glyphs that stand for a phrase with the term in it."""
    out = normalized_spans(text, term, limit)
    wanted = relaxed(term)
    for m in _GLYPH.finditer(text) if wanted else ():
        if len(out) < limit and wanted in relaxed(HONORIFICS[m.group()]):
            out.append(m.span())
    return out


def _source_tokens(text: str) -> list[tuple[str, int, int]]:
    """(term, start, end) of the text's tokens, and of what its glyphs stand for, in order of start."""
    out = [(t.term, t.start, t.end) for t in analyzer().tokens(text) if t.term != SENTINEL]
    out += [(term, *m.span()) for m in _GLYPH.finditer(text) for term in analyze(HONORIFICS[m.group()])]
    return sorted(out, key=lambda t: t[1])


def _analyzed(text: str, terms: list[str], mode: str, limit: int) -> tuple[list[Span], bool]:
    """The spans, and whether the mode's demand is met."""
    if mode not in MODES:
        raise ValueError("mode must be one of: any, all, phrase")
    wanted = [t for t in terms if t]
    if not text or limit <= 0 or not wanted:
        return [], False
    tokens = _source_tokens(text)
    if mode == "phrase":
        n = len(wanted)
        starts = [i for i in range(len(tokens) - n + 1) if [t[0] for t in tokens[i : i + n]] == wanted][:limit]
        return [(tokens[i][1], tokens[i + n - 1][2]) for i in starts], bool(starts)
    out: list[Span] = []
    for term in wanted:
        found = [(s, e) for t, s, e in tokens if t == term][:limit]
        out += found
        if mode == "all" and not found:
            return out, False
    return out, mode == "all" or bool(out)


def analyzed_spans(text: str | None, terms: list[str] | None, mode: str = "any", limit: int = PER_TERM) -> list[Span]:
    """Where tokens have one of the terms; nothing if the mode's demand isn't met."""
    spans, met = _analyzed(text or "", terms or [], mode, limit)
    return spans if met else []


def _normalized(text: str, terms: list[str], mode: str, limit: int) -> tuple[list[Span], bool]:
    if mode not in MODES:
        raise ValueError("mode must be one of: any, all, phrase")
    wanted = [t for t in terms if t]
    if mode == "phrase":
        out = _display_spans(text, " ".join(wanted), limit) if wanted else []
        return out, bool(out)
    out = []
    for term in wanted:
        found = _display_spans(text, term, limit)
        out += found
        if mode == "all" and not found:
            return out, False
    return out, bool(wanted) and (mode == "all" or bool(out))


def overlap(a: Span, b: Span) -> bool:
    return a[1] > b[0] and a[0] < b[1]


def select_spans(ranked: list[tuple[int, int, int]]) -> list[Span]:
    """Of (start, end, priority) no two that overlap: by priority, then the longer, the earlier."""
    picked: list[Span] = []
    for start, end, _ in sorted(ranked, key=lambda s: (s[2], s[0] - s[1], s[0], s[1])):
        if not any(overlap((start, end), p) for p in picked):
            picked.append((start, end))
    return sorted(picked)


def _first_spans(spans: list[Span]) -> list[Span]:
    """No two that overlap, the earlier one stays, of those the longer."""
    picked: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        if not picked or s[0] >= picked[-1][1]:
            picked.append(s)
    return picked


def parse_spans(csv: str | None, ranked: bool) -> list[tuple[int, ...]]:
    """Items start:end[:priority] between semicolons; others are left out."""
    shape = re.compile(r"\s*([+-]?\d+):\s*([+-]?\d+)" + (r":\s*([+-]?\d+)" if ranked else ""))
    out = []
    for item in (csv or "").split(";"):
        if m := shape.fullmatch(item):
            values = tuple(map(int, m.groups()))
            if 0 <= values[0] < values[1] and all(-(2**31) <= v < 2**31 for v in values):
                out.append(values)
    return out


def select_spans_csv(csv: str | None) -> str:
    return ";".join(f"{s}:{e}" for s, e in select_spans(parse_spans(csv, True)))


def mark(text: str, spans: list[Span], start: str, end: str) -> str:
    out, at = [], 0
    for s, e in spans:
        s = min(max(s, at), len(text))
        e = min(max(e, s), len(text))
        out += [text[at:s], start, text[s:e], end]
        at = e
    return "".join([*out, text[at:]])


def highlight_normalized(text, terms, mode, start, end, limit) -> str | None:
    """The text with marks around matches in relaxed spelling; null where the demand isn't met."""
    if not text or terms is None or mode is None or limit <= 0:
        return None
    spans, met = _normalized(text, terms, mode, limit)
    return mark(text, _first_spans(spans), start or "", end or "") if met and spans else None


def highlight_analyzed(text, terms, mode, start, end, limit, raw_terms=None) -> str | None:
    """The same by analysed terms; raw terms add matches in relaxed spelling, which can meet the demand."""
    if not text or terms is None or mode is None or limit <= 0:
        return None
    spans, met = _analyzed(text, terms, mode, limit)
    if raw_terms:
        wanted = [t for t in raw_terms if t]
        more = [s for t in ([" ".join(wanted)] if mode == "phrase" and wanted else wanted) for s in _display_spans(text, t, limit)]
        spans, met = spans + more, met or bool(more)
    return mark(text, _first_spans(spans), start or "", end or "") if met and spans else None


def snap_window(text: str | None, start: int, end: int, scan: int = SCAN) -> Span:
    """The window pushed outward to breaks within `scan` characters."""
    if not text:
        return 0, 0
    s, e = (min(max(x, 0), len(text)) for x in (start, end))
    scan = max(scan, 0)
    left = next((i for i in range(s, max(0, s - scan), -1) if text[i - 1] in _BREAKS), s)
    right = next((i for i in range(e, min(len(text), e + scan)) if text[i] in _BREAKS), e)
    return (left, right) if right > left else (s, max(e, s))


def render_snippet(text: str | None, start: int, end: int, spans: list[Span]) -> str:
    """The window with [[ ]] around spans, and … where it is cut off."""
    if not text:
        return ""
    s, e = (min(max(x, 0), len(text)) for x in (start, end))
    e = max(e, s)
    out = text[s:e]
    for a, b in sorted(spans, reverse=True):
        a = min(max(a - s, 0), len(out))
        b = min(max(b - s, a), len(out))
        out = out[:a] + "[[" + out[a:b] + "]]" + out[b:]
    return ("…" if s > 0 else "") + out + ("…" if e < len(text) else "")


# What a query says about a snippet

_SHOWN = re.compile("[0-9A-Za-zء-ي٠-٩۰-۹]+")
_ALL_DIGITS = re.compile("[0-9٠-٩۰-۹]+")


def _unique(items: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    for x in items:
        seen.setdefault(x.translate(_LOWER), x)
    return list(seen.values())


def _words(text: str) -> list[str]:
    return [w for w in _SHOWN.findall(text) if w.upper() not in syntax.OPERATORS and w.lower() not in syntax.FIELDS and not _ALL_DIGITS.fullmatch(w)]


def _shown_token(token: str) -> str:
    for field in syntax.FIELDS:
        if token.lower().startswith(field + ":") and len(token) > len(field) + 1:
            token = token[len(field) + 1 :]
            break
    at = syntax.find_last_bare(token, "^")
    if at >= 0 and re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", token[at + 1 :]):
        token = token[:at]
    at = syntax.find_last_bare(token, "~")
    return token[:at] if at >= 0 and token[at + 1 :] in ("", "0", "1", "2") else token


def _collect(clauses, terms: list[str], phrases: list[str]) -> None:
    for c in clauses:
        if isinstance(c.node, Group):
            _collect(c.node.clauses, terms, phrases)
            continue
        leaf: Leaf = c.node
        if group := syntax.field_group(leaf):
            _collect(syntax.parse(group[1]), terms, phrases)
        elif phrase := syntax.phrase_of(leaf):
            terms += _words(phrase[1])
            if phrase[1].strip():
                phrases.append(syntax.escape_quoted(phrase[1].strip()))
        elif leaf.kind == "token":
            terms += _words(_shown_token(leaf.value))


def query_terms(q: str | None) -> list[str]:
    """The words of a query that a snippet shows."""
    terms: list[str] = []
    _collect(syntax.parse(q or ""), terms, [])
    return _unique(terms)


def query_phrases(q: str | None) -> list[str]:
    phrases: list[str] = []
    _collect(syntax.parse(q or ""), [], phrases)
    return _unique(phrases)


def build_snippet(text: str | None, q: str | None) -> dict | None:
    """The best window of a text for a query: most phrases, most terms, most characters marked, earliest, shortest."""
    if not text or not q:
        return None
    values = [[(s, 0) for s in normalized_spans(text, p)] for p in query_phrases(q)]
    phrases = len(values)
    values += [[(s, 1) for s in normalized_spans(text, t)] for t in query_terms(q)]
    anchors = [s for v in values for s, _ in v] or [(0, 1)]
    best, seen = None, set()
    for anchor in anchors:
        size = anchor[1] - anchor[0]
        window = snap_window(text, max(0, anchor[0] - AROUND), min(len(text), anchor[0] + (size + AROUND if size else 2 * AROUND)))
        if window[1] <= window[0] or window in seen:
            continue
        seen.add(window)
        inside = [[(max(s[0], window[0]), min(s[1], window[1]), p) for s, p in v if overlap(s, window)] for v in values]
        marks = select_spans([x for v in inside for x in v])
        if not marks:
            clipped = (max(anchor[0], window[0]), min(anchor[1], window[1]))
            marks = [clipped] if clipped[1] > clipped[0] else []
        counts = [f(v for v in part if v) for part in (inside[:phrases], inside[phrases:]) for f in (lambda vs: sum(1 for _ in vs), lambda vs: sum(map(len, vs)))]
        chars = sum(e - s for s, e in marks)
        rank = (*(-n for n in counts), -chars, window[0], window[1] - window[0])
        if best is None or rank < best[0]:
            names = ("phrase_unique", "phrase_hits", "term_unique", "term_hits")
            best = rank, {"snippet": render_snippet(text, *window, marks), **dict(zip(names, counts)), "highlight_chars": chars, "start": window[0], "length": window[1] - window[0]}
    return best and best[1]


def best_field_snippet(page: str | None, title: str | None, q: str) -> tuple[str, str] | None:
    """(field, snippet) of the better of an item's two texts; the page wins ties."""
    found = [(name, s) for name, text in (("page", page), ("title", title)) if (s := build_snippet(text, q))]
    keys = ("phrase_unique", "phrase_hits", "term_unique", "term_hits", "highlight_chars")
    if not found:
        return None
    name, s = max(found, key=lambda x: tuple(x[1][k] for k in keys))
    return name, s["snippet"]


__all__ = ["QueryError", "analyzed_spans", "best_field_snippet", "build_snippet", "highlight_analyzed", "highlight_normalized", "normalized_spans", "query_phrases", "query_terms", "render_snippet", "select_spans", "select_spans_csv", "snap_window"]
