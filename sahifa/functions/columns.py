"""Scalar functions as Column expressions: they stay in the JVM, inside whole-stage code generation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .analyzer import _PREFIXES, _SUFFIXES

_DIACRITICS = "ـ" + "".join(map(chr, [*range(0x64B, 0x660), *range(0x6D6, 0x6EE)]))
_HAMZA, _LETTERS = "آأإ", "ىة"
_DIGITS = "".join(map(chr, [*range(0x660, 0x66A), *range(0x6F0, 0x6FA)]))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Forms:
    """Which distinctions of spelling are ignored."""

    diacritics: bool = True
    hamza: bool = True
    letters: bool = True
    digits: bool = True

    @property
    def strict(self) -> bool:
        return not (self.diacritics and self.hamza and self.letters and self.digits)

    def mapping(self, lower: bool = False) -> tuple[str, str]:
        """Characters and what they become; those past the end of the second string are dropped."""
        pairs = []
        if lower:
            pairs += zip(_UPPER, _UPPER.lower())
        if self.hamza:
            pairs += [(c, "ا") for c in _HAMZA]
        if self.letters:
            pairs += zip(_LETTERS, "يه")
        if self.digits:
            pairs += zip(_DIGITS, "0123456789" * 2)
        gone = _DIACRITICS if self.diacritics else ""
        return "".join(a for a, _ in pairs) + gone, "".join(b for _, b in pairs)


RELAXED = Forms()


def normalize(text: Column, forms: Forms = RELAXED, lower: bool = False) -> Column:
    """The text with the ignored distinctions gone; null stays null. Wildcards are never touched."""
    source, to = forms.mapping(lower)
    return F.translate(text, source, to) if source else text


@lru_cache
def translation(forms: Forms, lower: bool) -> dict[int, str | None]:
    source, to = forms.mapping(lower)
    return str.maketrans({c: (to[i] if i < len(to) else None) for i, c in enumerate(source)})


def normalize_text(text: str, forms: Forms = RELAXED, lower: bool = False) -> str:
    """The same in Python, on one text."""
    return text.translate(translation(forms, lower))


def _sensitive(forms: Forms) -> str:
    out = "" if forms.diacritics else _DIACRITICS
    out += "" if forms.hamza else _HAMZA
    out += "" if forms.letters else _LETTERS
    return out + ("" if forms.digits else _DIGITS + "0123456789")


def has_sensitive_forms(text: Column, forms: Forms) -> Column:
    """Whether the text has a character of a distinction that isn't ignored; false for null."""
    chars = _sensitive(forms)
    return F.coalesce(text.rlike(f"[{chars}]"), F.lit(False)) if chars else F.lit(False)


def text_is_sensitive(text: str, forms: Forms) -> bool:
    return any(c in _sensitive(forms) for c in text)


def wildcard_regex(pattern: str, anchored: bool) -> str:
    """* is any run, ? one code point; anchored patterns match whole terms, others anywhere in one line."""
    inside = "".join({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or ord(c) > 127 else "\\" + c) for c in pattern)
    return f"(?s)^{inside}\\z" if anchored else inside


def wildcard_match(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs in the text; an empty one does."""
    if not any(c in "*?" for c in pattern):
        return F.contains(text, F.lit(pattern))
    return text.rlike(wildcard_regex(pattern, False))


def glob_match(term: Column, pattern: str) -> Column:
    """Whether the pattern is the whole term; plain prefixes and suffixes can be pushed down to files."""
    head, tail = pattern[:-1], pattern[1:]
    if pattern.endswith("*") and not any(c in "*?" for c in head):
        return term.startswith(head)
    if pattern.startswith("*") and not any(c in "*?" for c in tail):
        return term.endswith(tail)
    return term.rlike(wildcard_regex(pattern, True))


def levenshtein_capped(a: Column, b: Column, most: int) -> Column:
    """The edit distance in code points, most + 1 where it is greater."""
    if most < 0:
        return F.lit(0)
    found = F.levenshtein(a, b, most)
    return F.when(found < 0, most + 1).otherwise(found)


def stem(word: Column) -> Column:
    """The light stem of a normalised word."""
    cut = word
    size = F.length(word)
    for prefix in reversed(_PREFIXES):
        least = max(len(prefix) + 2, 4 if len(prefix) == 1 else 0)
        cut = F.when(word.startswith(prefix) & (size >= least), F.substring(word, len(prefix) + 1, 1 << 30)).otherwise(cut)
    for suffix in _SUFFIXES:
        cut = F.regexp_replace(cut, f"(?s)^(.{{2,}}){suffix}\\z", "$1")
    return cut


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def f32_mul(a, b) -> Column:
    return (f32(a) * f32(b)).cast("float")


def f32_add(a, b) -> Column:
    return (f32(a) + f32(b)).cast("float")


def f32_div(a, b) -> Column:
    """Both sides single, the quotient rounded once: division gives a double, which holds the exact rounding."""
    return (f32(a) / f32(b)).cast("float")


def _int4(n: Column) -> Column:
    """Lossy code of a non-negative long: three bits after the leading one, and the shift."""
    bits = F.length(F.bin(n))
    shift = bits - 4
    code = F.call_function("shiftright", n.cast("long"), F.greatest(shift, F.lit(0))).bitwiseAND(F.lit(7)).bitwiseOR(F.shiftleft((shift + 1).cast("long"), 3))
    return F.when(n < 8, n.cast("long")).otherwise(code)


#: Lengths up to this one are kept as they are.
FREE_VALUES = 24


def int_to_byte4(n: Column) -> Column:
    """A length as one byte; negative ones fail."""
    n = F.when(n < 0, F.raise_error(F.lit("lengths aren't negative"))).otherwise(n)
    return F.when(n < FREE_VALUES, n.cast("long")).otherwise(FREE_VALUES + _int4(n - FREE_VALUES)).cast("int")


def byte4_to_int(code: Column) -> Column:
    """The length that a byte stands for; codes outside 0..255 fail."""
    code = F.when((code < 0) | (code > 255), F.raise_error(F.lit("a byte is from 0 to 255"))).otherwise(code)
    rest = (code - FREE_VALUES).cast("long")
    shift = (F.shiftright(rest, 3) - 1).cast("int")
    low = rest.bitwiseAND(F.lit(7))
    wide = F.call_function("shiftleft", low.bitwiseOR(F.lit(8)), F.greatest(shift, F.lit(0)))
    return F.when(code < FREE_VALUES, code.cast("long")).otherwise(FREE_VALUES + F.when(shift < 0, low).otherwise(wide))


def quantised(length: Column) -> Column:
    """A length as scoring sees it, byte4_to_int(int_to_byte4(length)): four binary digits of what is beyond FREE_VALUES."""
    n = F.greatest(length.cast("long"), F.lit(0).cast("long"))
    gone = F.greatest(F.length(F.bin(n - FREE_VALUES)) - 4, F.lit(0))
    return F.when(n < FREE_VALUES + 8, n).otherwise(FREE_VALUES + F.call_function("shiftleft", F.call_function("shiftright", n - FREE_VALUES, gone), gone))


def idf(doc_count, doc_freq) -> Column:
    n, df = f32(doc_count).cast("double"), f32(doc_freq).cast("double")
    value = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5)).cast("float")
    return F.when((n <= 0) | (df <= 0), F.lit(0.0).cast("float")).otherwise(value)


def norm_inverse(length: Column, avgdl, k1: float = K1, b: float = B) -> Column:
    """1 / (k1 * (1 - b + b * length / avgdl)), every step in single precision."""
    rest = (F.lit(1.0).cast("float") - f32(b)).cast("float")
    norm = f32_add(rest, f32_div(f32_mul(b, f32(length)), avgdl))
    under = f32_mul(k1, norm)
    return F.when(f32(avgdl) <= 0, F.lit(0.0).cast("float")).when(under <= 0, F.lit(0.0).cast("float")).otherwise(f32_div(1.0, under))


def norm_inverse_cache(avgdl, k1: float = K1, b: float = B) -> Column:
    """The 256 values of norm_inverse, by byte."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: norm_inverse(byte4_to_int(i), avgdl, k1, b))


def norm_inverse_values(avgdl: float, k1: float = K1, b: float = B) -> list[float]:
    """The same 256 values, worked out on the driver; the arrays are single precision throughout."""
    import numpy as np

    k1, b, avgdl = map(np.float32, (k1, b, avgdl))
    if avgdl <= 0:
        return [0.0] * 256
    code = np.arange(256) - FREE_VALUES
    length = np.where(code < 8, code + FREE_VALUES, FREE_VALUES + ((code & 7) | 8) * 2.0 ** np.maximum((code >> 3) - 1, 0)).astype(np.float32)
    under = k1 * ((np.float32(1) - b) + b * length / avgdl)
    with np.errstate(divide="ignore"):
        return np.where(under <= 0, np.float32(0), np.float32(1) / under).astype(np.float32).tolist()


def weighted_score(weight, tf, inverse: Column) -> Column:
    """BM25 of a term by its length's norm_inverse: w - w / (1 + tf * inverse); 0 where the weight is 0 or tf isn't positive."""
    w, tf = f32(weight), f32(tf)
    inner = f32_add(1.0, f32_mul(tf, inverse))
    score = (w - f32_div(w, inner)).cast("float")
    return F.when((w == 0) | (tf <= 0) | (inner <= 0), F.lit(0.0).cast("float")).otherwise(score)


def term_score(weight, tf, length: Column, avgdl, k1: float = K1, b: float = B) -> Column:
    """The same by the length; 0 too where k1 or avgdl isn't positive."""
    zero = F.lit(0.0).cast("float")
    found = weighted_score(weight, tf, norm_inverse(quantised(length), avgdl, k1, b))
    return F.when((f32(k1) <= 0) | (f32(avgdl) <= 0), zero).otherwise(found)


def select_spans(spans: Column) -> Column:
    """Of spans (start, end, priority): no two that overlap, by priority, then the longer, the earlier; in order of place."""
    valid = F.filter(spans, lambda s: (s.start >= 0) & (s.end > s.start))

    def order(a: Column, b: Column) -> Column:
        keys = [(a.priority, b.priority), (b.end - b.start, a.end - a.start), (a.start, b.start), (a.end, b.end)]
        out = F.lit(0)
        for x, y in reversed(keys):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    ranked = F.array_sort(valid, order)
    none = F.slice(ranked, 1, 0)
    picked = F.aggregate(ranked, none, lambda got, s: F.when(F.exists(got, lambda p: (s.end > p.start) & (s.start < p.end)), got).otherwise(F.concat(got, F.array(s))))
    return F.array_sort(F.transform(picked, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))


def snap_window(text: Column, start: Column, end: Column, scan: int = 12) -> Column:
    """A window (start, end) pushed outward to a break within `scan` code points; null text gives (0, 0)."""
    boundary = "[\\s`~!@#$%^&*()\\-_=+\\[{\\]}\\\\|;:'\",<.>/?،؛«»…]"
    size = F.length(text)
    s, e = (F.least(F.greatest(x, F.lit(0)), size) for x in (start, end))
    scan = max(scan, 0)
    before = F.substring(text, F.greatest(s - scan, F.lit(0)) + 1, F.least(s, F.lit(scan)))
    # Not $, which also matches before a line end that comes last.
    tail = F.regexp_extract(before, f"(?s)({boundary})([^{boundary[1:]}*)\\z", 2)
    found = before.rlike(f"(?s){boundary}[^{boundary[1:]}*\\z")
    left = F.when(found, s - F.length(tail)).otherwise(s)
    after = F.substring(text, e + 1, F.lit(scan))
    head = F.regexp_extract(after, f"(?s)^([^{boundary[1:]}*)({boundary})", 1)
    right = F.when(after.rlike(f"(?s)^[^{boundary[1:]}*{boundary}"), e + F.length(head)).otherwise(e)
    bad = right <= left
    out_start, out_end = F.when(bad, s).otherwise(left), F.when(bad, F.greatest(e, s)).otherwise(right)
    return F.struct(*[F.when(text.isNull(), 0).otherwise(x).cast("int").alias(name) for x, name in ((out_start, "start"), (out_end, "end"))])


def phrase_frequency(places: list[Column], gaps: list[int], slop: int) -> Column:
    """How many chains of strictly growing places, one of each list, have none more than `slop` beyond its gap from the first."""

    zero = F.lit(0).cast("long")

    def ways(prior: Column):
        def step(x: Column) -> Column:
            before = F.filter(prior, lambda p: p["at"] < x)
            return F.struct(x.alias("at"), F.aggregate(before, zero, lambda total, p: total + p["ways"]).alias("ways"))

        return step

    def within(first: Column, gap: int):
        return lambda x: (x > first) & (x - first <= gap + slop)

    def chains(first: Column) -> Column:
        if len(places) == 2:
            return F.size(F.filter(places[1], within(first, gaps[1]))).cast("long")
        state = F.array(F.struct(first.alias("at"), F.lit(1).cast("long").alias("ways")))
        for at, gap in zip(places[1:], gaps[1:]):
            state = F.transform(F.filter(at, within(first, gap)), ways(state))
        return F.aggregate(state, zero, lambda total, p: total + p["ways"])

    return F.coalesce(F.aggregate(places[0], zero, lambda total, first: total + chains(first)), zero)


def near_places(places: list[Column], slop: int) -> list[Column]:
    """Of each list the places within a run that has one of every list and at most `slop` others between the outer two."""
    far = slop + 1
    ends = places[0] if len(places) == 1 else F.array_distinct(F.concat(*places))

    def whole(end: Column) -> Column:
        out = F.lit(True)
        for at in places:
            out = out & F.exists(at, lambda x: (x <= end) & (end - x <= far))
        return out

    good = F.filter(ends, whole)
    return [F.filter(at, lambda x: F.exists(good, lambda end: (x <= end) & (end - x <= far))) for at in places]
