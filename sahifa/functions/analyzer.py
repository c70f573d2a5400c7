"""The analyser: text to terms with their places. Plain Python on one string; `index` and `udfs` run it in Arrow batches.

Code points fall into four classes (breaks, ASCII word characters, Arabic, other letters). A regular expression
finds the stretches that hold a token or several joined by connectors; those of one class without a connector are
one token as they are, and only the others go through the rules of `_joined_end`. What a raw token becomes is
kept, since words come again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

BREAK, ASCII, ARABIC, OTHER = range(4)
#: Stands for a token of which nothing is left but a lengthening mark; counted, but never shown.
SENTINEL = ""
MOST_CODE_POINTS = 255
#: What became of so many tokens is kept, and of so many stretches; not of longer ones, which hardly come again.
KEPT_TOKENS, KEPT_LENGTH = 50_000, 64

# Later lines win.
_CLASSES: list[tuple[int, str]] = [
    (OTHER, "80-10ffff"),
    (BREAK, "a6 ab ac ad b7 bb d7 f7 2997 2998 fb50-fdff fe70-feff fe10-fe1f fe30-fe4f ff00-ff65"),
    (BREAK, "2000-206f 20a0-20cf 2e00-2e7f 3000-303f 60c 61b 61f 66a-66d 6d4 a0 1680"),
    (ARABIC, "fdfa fdfb 640 670 64b-65f 6d6-6ed 200d"),
    (ARABIC, "621-63a 641-64a 66e 66f 671-6d3 6d5 6ee 6ef 6fa-6fc 6ff 660-669 6f0-6f9"),
    (ASCII, "30-39 41-5a 61-7a 5f"),
]


def _table() -> bytearray:
    table = bytearray(0x110000)
    for kind, text in _CLASSES:
        for part in text.split():
            low, _, high = part.partition("-")
            a, b = int(low, 16), int(high or low, 16)
            table[a : b + 1] = bytes([kind]) * (b - a + 1)
    return table


CLASS = _table()


def _set(kinds: set[int]) -> str:
    """The inside of a character set that matches code points of these classes."""
    out, start = [], None
    for cp in range(0x110001):
        inside = cp < 0x110000 and CLASS[cp] in kinds and not 0xD800 <= cp <= 0xDFFF
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(cp - 1))}")
            start = None
    return "".join(out)


_CONNECTORS = ":.'’;,،٫٬"
_WORD = _set({ASCII, ARABIC, OTHER})
_STRETCH = re.compile(f"[{_WORD}]+(?:[{re.escape(_CONNECTORS)}][{_WORD}]+)*")
_LATIN = re.compile(f"[{_set({ASCII, OTHER})}]+").fullmatch
_PLAIN_ARABIC = re.compile(f"[{_set({ARABIC})}]+").fullmatch
_MARKS = "‍" + "".join(map(chr, [*range(0x64B, 0x653), *range(0x6D6, 0x6EE), *range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100), *range(0xFE20, 0xFE30)]))
_DIGITS = {*"0123456789", *map(chr, range(0x660, 0x66A)), *map(chr, range(0x6F0, 0x6FA))}
_COMMAS = {",", "،", "٫", "٬"}

FOLD = str.maketrans({**{c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{0x660 + i: str(i) for i in range(10)}, **{0x6F0 + i: str(i) for i in range(10)}})
NORMALISE = str.maketrans({**dict.fromkeys("آأإ", "ا"), "ى": "ي", "ة": "ه", **dict.fromkeys(["ـ", *map(chr, range(0x64B, 0x653))])})

STOP_WORDS = frozenset(
    """
    ا أ أو أي أى او اي اى ب ف و به بها ثم في فيه فيها وفي من منه منها ومن لا ولا الا ألا إلا لكن ما وما كما فما عن مع اذا إذا
    ان أن إن انه أنه إنه انها أنها إنها بان بأن فان فأن وان وأن وإن التي التى الذي الذى الذين الي الى إلي إلى علي على عليه عليها
    اما أما إما ايضا أيضا كل وكل لم ولم لن ولن هي هى هو وهي وهى وهو فهي فهى فهو انت أنت لك له لها هذا هذه ذلك تلك هناك
    كان كانت وكان وكانت يكون تكون غير بعض قد نحو بين بينما منذ ضمن حيث الان الآن خلال بعد قبل حتى عند عندما لدى جميع
    """.split()
) - {"علي"}

_PREFIXES = ("ال", "وال", "بال", "كال", "فال", "لل", "و")
_SUFFIXES = ("ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي")

#: Glyphs that stand for a phrase.
HONORIFICS = {
    chr(cp): phrase
    for block, phrases in (
        (0xFBC3, "جل وعلا|دامت بركاتهم|رحمة الله تعالى عليه|رحمة الله عليهم|رحمة الله عليهما|رحمهم الله تعالى|رحمهما الله|رحمهما الله تعالى|رضي الله تعالى عنهم|حفظه الله|حفظه الله تعالى|حفظهم الله تعالى|حفظهما الله تعالى|صلى الله تعالى عليه وسلم|عجل الله فرجه الشريف|عليه الرحمة"),
        (0xFD40, "رحمه الله|رضي الله عنه|رضي الله عنها|رضي الله عنهم|رضي الله عنهما|رضي الله عنهن|صلى الله عليه وآله|عليه السلام|عليهم السلام|عليهما السلام|عليه الصلاة والسلام|قدس سره|صلى الله عليه وآله وسلم|عليها السلام|تبارك وتعالى|رحمهم الله"),
        (0xFD90, "رحمة الله عليه|رحمة الله عليها"),
        (0xFDC8, "رحمه الله تعالى|رضي الله تعالى عنه|رضي الله تعالى عنها|رضي الله تعالى عنهما|صلى الله عليه وعلى آله وسلم|عجل الله تعالى فرجه الشريف|كرم الله وجهه|سلامه علينا"),
        (0xFDFA, "صلى الله عليه وسلم|جل جلاله"),
        (0xFDFD, "بسم الله الرحمن الرحيم|سبحانه وتعالى|عز وجل"),
    )
    for cp, phrase in enumerate(phrases.split("|"), block)
}
_HONORIFIC = str.maketrans(HONORIFICS)


@dataclass(frozen=True)
class AnalyzerOptions:
    """How an index analyses: its stop words (None: the built-in list), words not stemmed, phrases for glyphs."""

    stop_words: frozenset[str] | None = None
    stem_exclusions: frozenset[str] = field(default_factory=frozenset)
    honorifics: bool = False

    @classmethod
    def parse(cls, *words: str) -> AnalyzerOptions:
        """From option words: stopwords X, stopwords=X, stem_exclusion X, stem_exclusion=X, disable_stopwords, honorific_expansions."""
        stop: set[str] | None = None
        exclusions: set[str] = set()
        honorifics = False
        rest = iter(words)
        for word in rest:
            name, equals, value = word.partition("=")
            if name in ("stopwords", "stem_exclusion"):
                if not equals:
                    value = next(rest, None)
                    if value is None:
                        raise ValueError(f"the option {name} needs a list")
                items = [x.strip(" \t") for x in value.split(",")]
                if name == "stopwords":
                    stop = (stop or set()) | {x for x in items if x}
                else:
                    exclusions |= {n for x in items if (n := x.translate(FOLD).translate(NORMALISE))}
            elif word == "disable_stopwords":
                stop = stop or set()
            elif word == "honorific_expansions":
                honorifics = True
            else:
                raise ValueError(f"unknown analyser option: {word}")
        return cls(None if stop is None else frozenset(stop), frozenset(exclusions), honorifics)


DEFAULT = AnalyzerOptions()


class Token(NamedTuple):
    """offset counts tokens that were kept, position stop words too; start and end are code points of the text."""

    term: str
    offset: int
    position: int
    start: int
    end: int


def stem(word: str) -> str:
    """Without the first prefix that fits, and each suffix that fits, in order; two letters at least stay."""
    for prefix in _PREFIXES:
        if word.startswith(prefix) and len(word) >= max(len(prefix) + 2, 4 if len(prefix) == 1 else 0):
            word = word[len(prefix) :]
            break
    for suffix in _SUFFIXES:
        if word.endswith(suffix) and len(word) >= len(suffix) + 2:
            word = word[: -len(suffix)]
    return word


def _same_kind(a: str, b: str) -> bool:
    return (a in _DIGITS) == (b in _DIGITS)


def _connects(kind: int, numeric: bool, before: str, mark: str, after: str) -> bool:
    """Whether a connector between two code points joins them, in a token that is of this class so far."""
    follows = CLASS[ord(after)]
    digits = before in _DIGITS and after in _DIGITS
    if numeric and after in _DIGITS and (mark == "." or mark in _COMMAS):
        return True
    if kind == OTHER:
        return False
    if mark == ";" or mark in _COMMAS:
        return digits
    if kind == ASCII:
        if mark == ":":
            return follows in (ASCII, ARABIC) and _same_kind(before, after)
        if mark == ".":
            return follows != BREAK and _same_kind(before, after)
        return follows == ASCII
    if mark == ":":
        return not numeric and follows != BREAK and after not in _DIGITS and not (before in _DIGITS and follows == ARABIC)
    if mark == ".":
        return not numeric and follows != BREAK and _same_kind(before, after)
    return follows in (ASCII, ARABIC) and _same_kind(before, after)


def _next_kind(kind: int, numeric: bool, before: str, c: str) -> int | None:
    """The class a token goes on with at a code point of another class; None ends it."""
    to = CLASS[ord(c)]
    if to == kind:
        return kind
    if (kind, to) == (ASCII, ARABIC) and (c in _DIGITS or before in ("_", ":")):
        return ARABIC
    if (kind, to) == (ARABIC, ASCII) and (c in _DIGITS or before in _DIGITS or numeric or before == ":"):
        return ASCII
    if {kind, to} == {ASCII, OTHER}:
        return OTHER
    return to if before == "." else None


def _joined_end(s: str, at: int) -> int:
    """Where the token that begins at `at` ends."""
    kind = CLASS[ord(s[at])]
    numeric = kind == ARABIC and s[at] in _DIGITS
    before, n = "\0", len(s)
    while at < n:
        c = s[at]
        if c in _CONNECTORS:
            if at + 1 < n and _connects(kind, numeric, before, c, s[at + 1]):
                before, at = c, at + 1
                continue
            return at
        if c == "_" and kind in (ASCII, ARABIC):
            before, at = c, at + 1
            continue
        to = _next_kind(kind, numeric, before, c)
        if to is None:
            return at
        if to != kind and (kind, to) == (ARABIC, ASCII) and c not in _DIGITS and before not in _DIGITS:
            numeric = False
        kind = to
        if numeric and c not in _DIGITS:
            numeric = False
        before, at = c, at + 1
    return at


def raw_tokens(text: str):
    """(start, raw token) of every token of the text."""
    for found in _STRETCH.finditer(text):
        s, base = found.group(), found.start()
        if _LATIN(s) or _PLAIN_ARABIC(s):
            bare = s.lstrip(_MARKS)
            if bare:
                yield base + len(s) - len(bare), bare
            continue
        at = 0
        while at < len(s):
            if CLASS[ord(s[at])] == BREAK or s[at] in _MARKS:
                at += 1
                continue
            end = _joined_end(s, at)
            yield base + at, s[at:end]
            at = end


#: What became of a raw token: its terms, or one of these.
DROPPED, STOPPED, EMPTIED = (), ("",), (SENTINEL,)


class _Numbers(dict):
    """A number for each key, in order of first use."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class Analyzer:
    def __init__(self, options: AnalyzerOptions = DEFAULT):
        self.options = options
        self.stop = STOP_WORDS if options.stop_words is None else options.stop_words
        self.kept: dict[str, tuple[str, ...]] = {}
        self.stretches: dict[str, tuple[str | None, ...]] = {}

    def _terms(self, raw: str) -> tuple[str, ...]:
        folded = raw.translate(FOLD)
        if not folded.strip("_"):
            return DROPPED
        if folded in self.stop:
            return STOPPED
        term = folded.translate(NORMALISE)
        if not term:
            return EMPTIED if "ـ" in folded else DROPPED
        if term not in self.options.stem_exclusions:
            term = stem(term)
        if len(term) <= MOST_CODE_POINTS:
            return (term,)
        return tuple(term[i : i + MOST_CODE_POINTS] for i in range(0, len(term), MOST_CODE_POINTS))

    def tokens(self, text: str | None, document: bool = False) -> list[Token]:
        """The text's tokens; a document also has sentinels, which take an offset and no position."""
        if not text:
            return []
        if self.options.honorifics:
            text = text.translate(_HONORIFIC)
        kept, out, offset, position = self.kept, [], 0, 0
        for start, raw in raw_tokens(text):
            terms = kept.get(raw)
            if terms is None:
                terms = self._terms(raw)
                if len(raw) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_TOKENS:
                        kept.clear()
                    kept[raw] = terms
            if terms is STOPPED:
                position += 1
            elif terms is EMPTIED:
                if document:
                    out.append(Token(SENTINEL, offset, position, start, start + len(raw)))
                    offset += 1
            else:
                for term in terms:
                    out.append(Token(term, offset, position, start, start + len(raw)))
                    offset += 1
                    position += 1
        return out

    def _stretch(self, s: str) -> tuple[str | None, ...]:
        """What a stretch holds: terms, None for a stop word."""
        out: list[str | None] = []
        for _, raw in raw_tokens(s):
            terms = self._terms(raw)
            out += (None,) if terms is STOPPED else terms
        found = tuple(out)
        if len(s) <= KEPT_LENGTH:
            if len(self.stretches) >= KEPT_TOKENS:
                self.stretches.clear()
            self.stretches[s] = found
        return found

    def places(self, text: str | None) -> dict[str, tuple[list[int], list[int]]]:
        """A document's terms with their offsets and positions, by the rules of tokens(document=True); sentinels have no positions."""
        found: dict[str, tuple[list[int], list[int]]] = {}
        if not text:
            return found
        if self.options.honorifics:
            text = text.translate(_HONORIFIC)
        known, offset, position = self.stretches.get, 0, 0
        for s in _STRETCH.findall(text):
            terms = known(s)
            if terms is None:
                terms = self._stretch(s)
            for term in terms:
                if term is None:
                    position += 1
                    continue
                at = found.get(term)
                if at is None:
                    at = found[term] = ([], [])
                at[0].append(offset)
                offset += 1
                if term != SENTINEL:
                    at[1].append(position)
                    position += 1
        return found

    def places_of(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """places() of several texts as arrays: each posting's text and term (a number in the list of terms), and its offsets and positions (all values; where each posting's begin, and the end)."""
        stretches, terms = _Numbers(), _Numbers()
        stop, sentinel = terms[None], terms[SENTINEL]
        each = []
        for text in texts:
            if text and self.options.honorifics:
                text = text.translate(_HONORIFIC)
            each.append(np.fromiter(map(stretches.__getitem__, _STRETCH.findall(text or "")), np.int32))
        found = [self.stretches.get(s) for s in stretches]
        found = [self._stretch(s) if f is None else f for s, f in zip(stretches, found)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((terms[t] for f in found for t in f), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        # All entries of all texts, in order.
        at = np.concatenate(each) if each else np.zeros(0, np.int32)
        n = size[at]
        entry = flat[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        text_of = np.repeat(np.repeat(np.arange(len(each)), [len(e) for e in each]), n)
        first = np.searchsorted(text_of, np.arange(len(each)))
        places = []
        for unplaced in (stop, sentinel):
            before = np.cumsum(entry != unplaced) - (entry != unplaced)
            places.append((before - before[np.minimum(first, max(len(entry) - 1, 0))][text_of] if len(entry) else before).astype(np.int32))
        kept = np.flatnonzero(entry != stop)
        key = text_of[kept] * len(terms) + entry[kept]
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        # Postings in order of their first place.
        length, by = np.diff(starts, append=len(order)), np.argsort(order[starts], kind="stable")
        starts, length = starts[by], length[by]
        ends = np.cumsum(length)
        order = kept[order[np.repeat(starts - (ends - length), length) + np.arange(len(order))]]
        head = order[ends - length]
        placed = np.where(entry[head] == sentinel, 0, length)
        lists = [(places[0][order], np.append(0, ends)), (places[1][order[entry[order] != sentinel]], np.append(0, np.cumsum(placed)))]
        return text_of[head], list(terms), entry[head], *lists

    def terms(self, text: str | None) -> list[str]:
        return [t.term for t in self.tokens(text)]


_analyzers: dict[AnalyzerOptions, Analyzer] = {}


def analyzer(options: AnalyzerOptions = DEFAULT) -> Analyzer:
    """The process's analyser for these options."""
    found = _analyzers.get(options)
    if found is None:
        found = _analyzers[options] = Analyzer(options)
    return found


def analyze(text: str | None) -> list[str]:
    """Terms by the default options, as all helpers and queries have them."""
    return analyzer().terms(text)


def phrase_terms(text: str) -> tuple[list[str], list[int]]:
    """A phrase's terms, and their positions counted from the first."""
    found = analyzer().tokens(text)
    return [t.term for t in found], [t.position - found[0].position for t in found]
