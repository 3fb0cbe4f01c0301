"""The predicates of the document flow over one text, for Arrow batches: those of predicates.py and text.compact as plain functions.

As Columns they decode a text for each pattern, run lambdas over its lines interpreted, and test everything; here a rule is
tested only if those before it don't decide, and words are looked up in a set. Patterns are those of patterns.py, translated:
in texts, characters that Java and Python tell differently to be of words are replaced before. A test holds both forms against
each other.
"""

from __future__ import annotations

import math
import math
import re
import unicodedata
from functools import cached_property, lru_cache

from . import patterns as P
from . import plain
from .plain import _WORD, cjk, collapse, lines, occurrences, repair_unicode

_ENDS = r"\n\r\x85\u2028\u2029"


def _differing() -> dict[int, str]:
    """Characters that Python and Java tell differently to be of words or white space, and what stands for them."""
    word = re.compile(f"[{_WORD}]")
    out = {k: "\x01" for k in range(0x1C, 0x20)}
    for k in (*range(0x80, 0x20001), *range(0xE0000, 0xE0200)):
        c = chr(k)
        if c.isalnum() != (is_word := word.match(c) is not None):
            out[k] = "ª" if is_word else "¤"
    return out


_MAP = _differing()
_DIFFERS = re.compile("[" + "".join(map(chr, (k for k in _MAP if k < 0x10000))) + "\U00010000-\U0010ffff]")


@lru_cache(64)
def _shadow(x: str) -> str:
    return x.translate(_MAP) if _DIFFERS.search(x) else x


def shadow(x: str) -> str:
    """x, with characters of the same kinds where Python's classes aren't Java's: what patterns are matched against."""
    return x if x.isascii() else _shadow(x)


def translated(pattern: str) -> str:
    """A pattern of Java for Python's re, but for its classes: its ends, and a point that no end of a line matches."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(r"\Z" if pattern[k + 1] == "z" else pattern[k : k + 2])
            k += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "[":
            out.append("\\")
        elif c == "]" and inside:
            inside = False
        if not inside and c == "$":
            out.append(rf"(?=(?:\r\n|[{_ENDS}])?\Z)")
        elif not inside and c == ".":
            out.append(f"[^{_ENDS}]")
        else:
            out.append(c)
        k += 1
    return "".join(out)


class Pattern:
    """A pattern of patterns.py: for ASCII texts, and for the shadows of all others."""

    def __init__(self, pattern: str):
        flags = (m := re.match(r"\(\?([iU]+)\)", pattern)) and m[1] or ""
        body, case = pattern[m.end() if m else 0 :], re.I if "i" in flags else 0
        self.ascii = re.compile(translated(body), case | re.A)
        self.wide = re.compile(translated(body), case) if "U" in flags else self.ascii
        # What is bound to the start isn't looked for elsewhere.
        self.run = [p.match if body[0] == "^" else p.search for p in (self.ascii, self.wide)]

    def search(self, x: str) -> re.Match | None:
        return self.run[0](x) if x.isascii() else self.run[1](_shadow(x))

    def count(self, x: str) -> int:
        return sum(1 for _ in (self.ascii.finditer(x) if x.isascii() else self.wide.finditer(_shadow(x))))


_NAMES = [
    "URL", "CODE", "CITATION", "CAPTION", "TABLE_CAPTION", "TABLE_NOTE", "TABLE_HEADER", "NUMERIC_ROW", "SYMBOLIC_ROW", "SYMBOL_TOKEN", "NUMBER", "LIST_ITEM", "JOINER_END", "HEADING_LINE", "FORMULA", "LATEX_COMMAND", "CALL", "DISPLAY_EQUATION", "MATH_STRUCTURE", "OPTIMUM",
    "PROSE_LEAD", "PROSE_HINT", "THEOREM", "REFERENCE_HEADING", "REFERENCE_START", "BRACKET_START", "YEAR", "VENUE", "AUTHOR", "FOOTER_HINT", "LICENCE", "ALGORITHM_HEADING", "ALGORITHM_IO", "ALGORITHM_IO_COLON", "ALGORITHM_STEP",
    "ALGORITHM_CONTROL", "ALGORITHM_FOR", "ALGORITHM_END", "NUMBERED_PROSE", "ACADEMIC_LABEL", "BULLET", "NUMBERED_LINE", "LIST_LEAD_IN", "STRUCTURE_LINE", "STRUCTURE_TOKEN", "NARRATIVE_HINT", "TABLE_VERB", "FRAGMENT_VERB",
    "FRAGMENT_NOUN", "PROPOSAL", "HEADER_HINT", "TABLE_CONTINUATION", "ACRONYM", "SHORT_TOKEN", "ANY_WORD", "TARGET_HEADING",
]
J = {n: Pattern(getattr(P, n)) for n in _NAMES}


def has(name: str, x: str) -> bool:
    return J[name].search(x) is not None


def _terms(pattern: str) -> frozenset[str]:
    """The words of a pattern that is nothing but words between boundaries."""
    found = re.fullmatch(r"\(\?i?U\)\\b\(([a-z|]+)\)\\b", pattern)
    return frozenset(found[1].split("|"))


#: Patterns that are lists of words; a text is searched for them by its set of words.
TERMS = {n: _terms(getattr(P, n)) for n in ("NARRATIVE_HINT", "TABLE_VERB", "FRAGMENT_VERB", "FRAGMENT_NOUN", "PROPOSAL")}
#: Others, of which some branches aren't words alone: the words, and what a text must hold for any other branch.
_HINT_TERMS = frozenset("where if when let thus then assume assuming note denote denotes define defined represents".split())
_VENUE_TERMS = frozenset("ieee acm springer elsevier wiley journal transactions proc conference symposium doi arxiv".split())
_HEADER_TERMS = frozenset("ieee transactions journal vol no january february march april may june july august september october november december".split())
_MORE_TERMS = frozenset("that which where if then means mean known stored locally initially suppose assuming assume let denote denotes recording variable".split())
_HEADS = frozenset("method metric measured parameter prototype component".split()), frozenset("accuracy precision recall f1 auc latency throughput mean max min std variance result".split())
_METRICS, _METHODS = frozenset(P.METRIC_TERMS), frozenset(P.METHOD_TERMS)
#: Letters that equal one of ASCII's when case is ignored but don't become it in lower case.
_ODD_CASE = re.compile("[ſKİı]")

_ASCII_TOKENS, _TOKENS = re.compile(r"\w+", re.A), re.compile(r"\w+")
_LONG = [re.compile(r"[A-Za-z](?<!\w[A-Za-z])[A-Za-z]{2,}(?!\w)", f) for f in (re.A, 0)]
_HEADER_TOKENS = re.compile(r"[a-z][a-z0-9\-]{1,}")
_LATIN = re.compile(r"[A-Za-z]+")
_LETTERS = bytes(k for k in range(128) if chr(k).isalpha())
_MATH = re.compile("[" + P.MATH_CHARS + r"=+*^_<>/-](?:(?<![-/])|(?<=[0-9)\]} _=+*/^<>-][-/])|(?<=\A[-/])|(?=[0-9(\[{ _=+*/^<>-]|\Z))")
_NO_WORDS = re.compile(r"[\W\d_]+\Z")
_NUMBER_ONLY = re.compile(r"\d{1,5}\Z")
_SOME_NUMBER, _ET_AL = Pattern(r"(?U)\b\d{3,5}\b"), Pattern(r"(?U)\bet al\.:")
_ANY_OPERATOR, _GRID = re.compile(r"[=<>≤≥+\-*/^_()]"), re.compile(r"[|/]| {2,}|\t")
_DIGIT, _SYMBOL = re.compile(r"\d"), re.compile(r"[\d_'\-^/]")
_TITLE = re.compile(r"[=<>\\/\[\]{}_^$]")
_BREAK, _SEMI = plain._java(r"\s*\n+\s*"), plain._java(r"\s*;(?:\s*;)+\s*")


def math_symbols(x: str) -> int:
    return len(_MATH.findall(x))


def letters(x: str) -> int:
    return len(x) - len(x.encode().translate(None, _LETTERS)) if x.isascii() else sum(map(str.isalpha, x))


def capitals(x: str) -> int:
    return sum(unicodedata.category(c) == "Lu" for c in x)


def ratio(a: float, b: float) -> float:
    return a / max(b, 1.0)


def tokens(x: str) -> list[str]:
    """Words of any characters of words."""
    return _ASCII_TOKENS.findall(x) if x.isascii() else _TOKENS.findall(_shadow(x))


def words(x: str) -> int:
    return len(_LONG[0].findall(x)) if x.isascii() else len(_LONG[1].findall(_shadow(x)))


class Text:
    """A view of a text, as text.View; each part is computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.lines = lines(self.text)
        self.flat = " ".join(self.text.split())
        self.lower = self.flat.lower()
        self.n_lines, self.length = len(self.lines), len(self.flat)

    @cached_property
    def rows(self) -> list[str]:
        return [self.flat] if self.n_lines == 1 else [collapse(x) for x in self.lines]

    @cached_property
    def tokens(self) -> list[str]:
        """In lower case."""
        return tokens(self.lower)

    @cached_property
    def terms(self) -> frozenset[str]:
        return frozenset(self.tokens)

    @cached_property
    def odd(self) -> bool:
        return not self.flat.isascii() and _ODD_CASE.search(self.flat) is not None

    @cached_property
    def words(self) -> int:
        return words(self.flat)

    @cached_property
    def cjk(self) -> int:
        return cjk(self.flat)

    @cached_property
    def latin(self) -> int:
        return sum(map(len, _LATIN.findall(self.flat)))

    @cached_property
    def punct(self) -> int:
        return occurrences(self.flat, ".?!;:")

    @cached_property
    def avg_line(self) -> float:
        return sum(map(len, self.lines)) / max(self.n_lines, 1)

    @cached_property
    def avg_row(self) -> float:
        return sum(map(len, self.rows)) / max(self.n_lines, 1)

    @cached_property
    def alpha(self) -> float:
        return ratio(letters(self.flat), self.length)

    @cached_property
    def math(self) -> int:
        return math_symbols(self.flat)

    def any_term(self, name: str) -> bool:
        return has(name, self.flat) if self.odd else not TERMS[name].isdisjoint(self.terms)

    @cached_property
    def year(self) -> bool:
        return ("19" in self.flat or "20" in self.flat) and has("YEAR", self.flat)

    @cached_property
    def venue(self) -> bool:
        return not _VENUE_TERMS.isdisjoint(self.terms) or ((self.odd or (_DIGIT.search(self.flat) is not None and any(x in self.lower for x in ("vol", "no", "pp")))) and has("VENUE", self.flat))

    @cached_property
    def author(self) -> bool:
        return "." in self.flat and has("AUTHOR", self.flat)

    @cached_property
    def prose_hint(self) -> bool:
        return not _HINT_TERMS.isdisjoint(self.terms) or ((self.odd or "s.t." in self.lower or "subject to" in self.lower) and has("PROSE_HINT", self.flat))

    @cached_property
    def goes_on(self) -> bool:
        """TABLE_CONTINUATION over the text in lower case, where no letter has an odd case but the dotless i and the long s."""
        return not _MORE_TERMS.isdisjoint(self.terms) or (("example" in self.lower or self.odd) and has("TABLE_CONTINUATION", self.flat))

    @cached_property
    def starts(self) -> int:
        return sum(has("REFERENCE_START", x) for x in self.rows if x[0] == "[" or x[0].isdecimal())

    # Predicates; their rules stand in predicates.py.

    @cached_property
    def licence_watermark(self) -> bool:
        low = self.lower
        if "authorized licensed use limited to" in low:
            return True
        if self.length > 420:
            return False
        hits = sum(s in low for s in P.LICENCE_SIGNALS) + ("republication/redistribution" in low or "republication redistribution" in low)
        return hits >= 2 and hits + has("LICENCE", self.flat) >= 3

    def running_header_footer(self, y0: float, y1: float, page_height: float) -> bool:
        top, bottom = y1 <= page_height * 0.095, y0 >= page_height * 0.90
        if not (top or bottom) or page_height <= 0 or not self.flat:
            return False
        flat, low = self.flat, self.lower
        if _NUMBER_ONLY.match(flat):
            return True
        if top:
            if not _HEADER_TERMS.isdisjoint(self.terms) or (self.odd and has("HEADER_HINT", flat)):
                return True
            if self.length <= 42 and self.words <= 6 and flat.upper() == flat and letters(flat) > 0:
                return True
            if self.length <= 180 and "et al.:" in low and _ET_AL.search(low) and _SOME_NUMBER.search(flat):
                return True
            if ":" in flat and _SOME_NUMBER.search(flat) and (n := letters(flat)) >= 10 and ratio(capitals(flat), n) >= 0.42:
                return True
        return bottom and (
            self.licence_watermark or has("FOOTER_HINT", flat) or (self.length <= 56 and self.words <= 7 and ("downloaded on" in low or "ieee xplore" in low))
        )

    @cached_property
    def numbered_narrative_list(self) -> bool:
        if self.n_lines < 3 or self.words < 16:
            return False
        numbered = [x for x in self.rows if has("NUMBERED_LINE", x)]
        n = len(numbered)
        if n < 2 or (sum(has("BRACKET_START", x) for x in self.rows) >= 2 and (self.year or self.venue)):
            return False
        return (n >= 3 and ratio(sum(map(words, numbered)), n) >= 4) or has("LIST_LEAD_IN", self.flat)

    @cached_property
    def narrative_prose(self) -> bool:
        n, w, p = self.n_lines, self.words, self.punct
        if n == 0 or w < 5:
            return False
        if n <= 3 and w >= 10 and p >= 2 and self.alpha >= 0.35 or w >= 26 and p >= 2 and self.alpha >= 0.45:
            return True
        if n <= 3 and w >= 14 and p >= 1 and self.avg_row >= 42 and self.alpha >= 0.36 or n >= 3 and w >= 24 and p >= 1 and self.avg_row >= 40:
            return True
        if any(has("ACADEMIC_LABEL", x) for x in self.rows[:2]):
            return True
        return w >= 16 and (self.numbered_narrative_list or any(has("BULLET", x) and words(x) >= 6 for x in self.rows))

    @cached_property
    def paragraph_block(self) -> bool:
        if self.n_lines == 0:
            return False
        ends = occurrences(self.text, ".?!;")
        return ends >= 1 and self.words >= 8 if self.n_lines < 3 else self.avg_line > 48 or ends >= 2

    @cached_property
    def fragment(self) -> bool:
        return self.words >= 4 and self.any_term("FRAGMENT_VERB") and (_ANY_OPERATOR.search(self.flat) is not None or self.any_term("FRAGMENT_NOUN"))

    @cached_property
    def algorithm_block(self) -> bool:
        own = self.lines
        if not own:
            return False
        is_io = [has("ALGORITHM_IO", x) for x in own]
        io = sum(f and (len(collapse(x)) <= 88 or has("ALGORITHM_IO_COLON", x)) for f, x in zip(is_io, own))
        heading = any(has("ALGORITHM_HEADING", x) for x in own[:2])
        steps = sum(has("ALGORITHM_STEP", x) for x in own)
        # Without a heading, an input or three steps, four lines must look like code.
        if not heading and io == 0 and steps < 3 and self.n_lines < 4:
            return False
        controls, fors = [has("ALGORITHM_CONTROL", x) for x in own], [has("ALGORITHM_FOR", x) for x in own]
        control = sum(controls) + sum(fors)
        ends = sum(has("ALGORITHM_END", x) for x in own)
        pseudo = sum(len(x) <= 120 and (a or b or c) for x, a, b, c in zip(own, is_io, controls, fors))
        labelled = any(has("ACADEMIC_LABEL", x) for x in own[:2])
        w, p = self.words, self.punct
        if w >= 120 and io <= 1 and ends == 0:
            return False
        if io == 0 and ends == 0:
            if labelled and (w >= 24 or steps <= 2) or w >= 34 and p >= 2 and steps <= 2 or w >= 64 and p >= 6 and self.narrative_prose:
                return False
            if steps >= 3 and control <= 1 and sum(has("NUMBERED_PROSE", x) for x in own) >= 2:
                return False
        if heading and (io >= 1 or steps >= 1 or control >= 1 or pseudo >= 3 or (self.n_lines >= 4 and self.avg_line <= 70 and p <= 1 and not self.narrative_prose)):
            return True
        return (io >= 1 and (steps >= 1 or control >= 1)) or (steps >= 3 and (control >= 2 or ends >= 1)) or (pseudo >= 4 and (steps >= 2 or io >= 1))

    @cached_property
    def explains(self) -> bool:
        return self.punct >= 1 and ((self.words >= 8 and "example" in self.lower) or (self.words >= 10 and self.goes_on))

    @cached_property
    def table_caption(self) -> bool:
        if self.n_lines == 0 or self.rows[0][0] not in "tT" or not has("TABLE_CAPTION", self.rows[0]):
            return False
        w, p, low = self.words, self.punct, self.lower
        return not (
            (w >= 6 and self.verb) or w >= 36 or (self.n_lines >= 3 and w >= 18) or (p >= 2 and w >= 14) or (w >= 12 and p >= 1 and ("," in self.flat or has("TABLE_CONTINUATION", low))) or (w >= 10 and (" that " in low or " since " in low))
        )

    @cached_property
    def verb(self) -> bool:
        """TABLE_VERB over the text in lower case."""
        return has("TABLE_VERB", self.lower) if self.odd else not TERMS["TABLE_VERB"].isdisjoint(self.terms)

    def headed(self, n_lines: int, text: str, prose: bool) -> bool:
        """table_header; the number of lines and the text are parameters, as the test is done on the text as one line too."""
        if not self.flat or self.explains or prose:
            return False
        if self.notation_header:
            return True
        found = set(self.header_tokens)
        metrics = len(_METRICS & found)
        if len(self.header_tokens) < 3 or metrics < 2:
            return False
        return metrics >= 3 or n_lines >= 2 or not _METHODS.isdisjoint(found) or _GRID.search(text) is not None or _DIGIT.search(text) is not None

    @cached_property
    def header_tokens(self) -> list[str]:
        return _HEADER_TOKENS.findall(self.lower)

    @cached_property
    def notation_header(self) -> bool:
        t = self.terms
        hinted = ("notation" in t and "definition" in t) or not (_HEADS[0].isdisjoint(t) or _HEADS[1].isdisjoint(t))
        return (hinted or self.odd) and has("TABLE_HEADER", self.lower)

    @cached_property
    def table_header(self) -> bool:
        return self.headed(self.n_lines, self.text, self.narrative_prose)

    @cached_property
    def any_row(self) -> bool:
        return any(map(is_row, self.rows))

    @cached_property
    def table_body(self) -> bool:
        n = self.n_lines
        if n == 0 or self.explains or self.narrative_prose:
            return False
        if self.any_row:
            return True
        ends = sum(occurrences(x, ".?!") for x in self.lines)
        if n < 4:
            if n < 2 or (ends >= 1 and self.words >= 8):
                return False
            numeric = sum(J["NUMBER"].count(x) >= 3 for x in self.lines)
            return numeric >= 2 or (n >= 3 and numeric >= 1 and sum(has("SYMBOL_TOKEN", x) for x in self.lines) >= 2)
        if ends > max(2, n // 3):
            return False
        if n >= 8 and sum(len(x) <= 78 for x in self.lines) / n >= 0.65:
            leads = list(map(lead, self.rows))
            if sum(k >= 1 for k in leads) / n >= 0.34 and sum(k == 2 for k in leads) / n >= 0.24:
                return True
        one = Text(self.flat)
        return one.headed(one.n_lines, self.flat, one.narrative_prose)

    @cached_property
    def table_like(self) -> bool:
        if not self.flat or self.explains:
            return False
        if self.table_caption:
            return True
        if self.narrative_prose:
            return False
        if self.table_header or self.table_body:
            return True
        n = self.n_lines
        if n < 2 or sum(len(x) <= 96 for x in self.rows) / n < 0.6:
            return False
        return sum(is_row(x) or (len(x) <= 96 and J["NUMBER"].count(x) >= 3) for x in self.rows) >= 2

    @cached_property
    def contributions(self) -> bool:
        return "contribution" in self.lower and any(t in self.lower for t in P.PROPOSAL_VERBS)

    @cached_property
    def reference_entry(self) -> bool:
        if self.n_lines == 0:
            return False
        s, w = self.starts, self.words
        first = self.rows[0]
        leads = s >= 1 and has("REFERENCE_START", first)
        # Every rule needs a line that starts like an entry, or an author and a year.
        if s == 0 and not (self.year and self.author):
            return False
        if s >= 1 and self.contributions or s <= 2 and not self.year and (has("PROPOSAL", self.lower) if self.odd else not TERMS["PROPOSAL"].isdisjoint(self.terms)):
            return False
        return (
            (s >= 2 and w <= 120 and self.n_lines <= 12 and (self.venue or (self.year and self.author)))
            or (leads and (self.year or self.venue or self.author))
            or (s >= 1 and self.year and (" doi" in self.lower or " arxiv" in self.lower))
            or (self.n_lines <= 4 and self.avg_line <= 120 and self.author and self.year and (s >= 1 or self.venue))
            or (s >= 1 and w <= 48 and self.year and self.venue)
        )

    @cached_property
    def formula_narrative(self) -> bool:
        if self.n_lines == 0:
            return False
        flat, w, n = self.flat, self.words, self.math
        lead = has("PROSE_LEAD", flat)
        if w < 3:
            return n >= 1 and (lead or self.prose_hint) and J["ANY_WORD"].count(flat) >= 2
        if n >= 1 and (lead or (w >= 4 and self.prose_hint)):
            return True
        hints = J["NARRATIVE_HINT"].count(flat) if self.odd else sum(t in TERMS["NARRATIVE_HINT"] for t in self.tokens)
        return hints >= 2 or (hints >= 1 and w >= 5 and any(c in flat for c in ",;:"))

    @cached_property
    def formula_block(self) -> bool:
        if self.n_lines < 2:
            return False
        facts = [(formula_line(x), words(x)) for x in self.lines]
        found = sum(f for f, _ in facts)
        if found == 0 or sum(n for _, n in facts) >= 10:
            return False
        prose = [n for f, n in facts if not f and n >= 6]
        if sum(prose) >= 8 or self.formula_narrative:
            return False
        return found >= 2 or (self.n_lines <= 4 and len(prose) <= 1)

    @cached_property
    def standalone_caption(self) -> bool:
        flat, low, w, p = self.flat, self.lower, self.words, self.punct
        if not has("CAPTION", flat) or (w >= 6 and self.verb) or w >= 36 or (p >= 2 and w >= 14):
            return False
        that, comma = " that " in low, "," in flat
        if w >= 12 and p >= 1 and (comma or that or " which " in low or " including " in low) or w >= 8 and (that or " since " in low or comma):
            return False
        return w <= 12 or ratio(capitals(flat), letters(flat)) >= 0.55

    @cached_property
    def skipped(self) -> bool:
        x = self.text.strip()
        w = self.words
        if x == "" or _NO_WORDS.match(shadow(x)) or (("://" in x or "." in x) and has("URL", x)) or has("CITATION", x) or self.standalone_caption:
            return True
        if w < 6 and x.count(" ") < 40 and has("CODE", x):
            return not self.formula_narrative
        theorem = lambda: w >= 4 and has("THEOREM", x)
        hint = lambda: w >= 4 and has("PROSE_HINT", x)
        if self.formula_block:
            return not (theorem() or self.formula_narrative)
        if w < 10 and ratio(symbols(x), len(x)) > 0.35:
            return not (self.formula_narrative or hint())
        # Text of six words is wanted, whether it is a formula or not.
        return w < 6 and formula(x) and not (theorem() or self.formula_narrative or hint())

    @cached_property
    def translatable(self) -> bool:
        if not self.flat or self.skipped:
            return False
        w, zh = self.words, self.cjk
        return not ((w == 0 and zh > 0) or (zh >= 16 and w <= 2) or (zh >= 48 and w <= 5 and self.latin <= 28))

    @cached_property
    def title_block(self) -> bool:
        return (
            self.flat != "" and 1 <= self.n_lines <= 4 and 6 <= self.words <= 36 and self.cjk <= 2 and self.punct <= 2 and self.avg_line >= 18
            and not any(t in self.flat for t in ("http://", "https://", "doi", "arxiv")) and not _TITLE.search(self.flat)
        )

    @cached_property
    def keeps_lines(self) -> bool:
        if self.n_lines < 3:
            return False
        if sum(has("STRUCTURE_LINE", x) for x in self.rows) >= 2:
            return True
        return ratio(sum(len(x) <= 92 for x in self.rows), self.n_lines) >= 0.45 and J["STRUCTURE_TOKEN"].count(" ".join(self.rows)) >= 3


def symbols(x: str) -> int:
    """Characters that are no letters, no numbers and no white space."""
    return sum(not (c.isalpha() or c.isspace() or unicodedata.category(c)[0] == "N") or "\x1c" <= c <= "\x1f" for c in x)


def formula(x: str) -> bool:
    """x is stripped."""
    size = len(x)
    n = math_symbols(x)
    return size > 0 and (
        (n >= 2 and size <= 220 and (_DIGIT.search(x) is not None or J["SHORT_TOKEN"].count(x) >= 3))
        or (n >= 2 and size <= 180 and words(x) <= 5)
        or has("FORMULA", x)
        or has("LATEX_COMMAND", x)
        or (size <= 160 and has("CALL", x))
    )


def formula_line(x: str) -> bool:
    n = math_symbols(x)
    return x != "" and (
        (n >= 3 and len(x) <= 260 and n / len(x) >= 0.08) or formula(x) or (n >= 1 and has("OPTIMUM", x)) or (has("DISPLAY_EQUATION", x) and has("MATH_STRUCTURE", x))
    )


def is_row(x: str) -> bool:
    """A row of numbers or symbols, which ends with one."""
    return (x[-1:].isdecimal() and has("NUMERIC_ROW", x)) or (x[-1:] != "" and (x[-1] in "×x✓-" or "0" <= x[-1] <= "9") and has("SYMBOLIC_ROW", x))


def lead(x: str) -> int:
    parts = x.split(" ")
    n, first = len(parts), parts[0].strip(",;:.()[]{}")
    if n < 2 or n > 18 or not first or not (_SYMBOL.search(first) or len(first) <= 2 or (first.upper() == first and first.lower() != first)):
        return 0
    return 2 if n <= 14 else 1


def repaired(x: str) -> str:
    return repair_unicode(x if x.isascii() else unicodedata.normalize("NFKC", x))


def compact(c: str | None) -> str | None:
    """text.compact"""
    if c is None:
        return None
    x = repaired(c)
    if "\n" not in x:
        glued = x
    else:
        glued = x.replace("-\n", "")
        if Text(x).keeps_lines:
            return "\n".join(plain._RUN.sub(" ", s).strip() for s in lines(glued))
    if "\n" not in x and len(x.splitlines()) >= 3 and Text(x).keeps_lines:
        return "\n".join(plain._RUN.sub(" ", s).strip() for s in lines(glued))
    if "\n" in glued:
        glued = _BREAK.sub(" ; ", glued)
    if glued.count(";") >= 2:
        glued = _SEMI.sub(" ; ", glued)
    return plain._RUN.sub(" ", glued).strip()


# A page's fragments ----------------------------------------------------------------------------------------------------


class Fragment:
    """A block of a page as grouping.mergeable looks at it."""

    def __init__(self, block_index: int, box: tuple, text: str | None, page_width: float):
        self.block_index, (self.x0, self.y0, self.x1, self.y1, self.font) = block_index, box
        self.text = text or ""
        self.flat = collapse(self.text)
        self.half = 0 if (self.x0 + self.x1) * 0.5 < page_width * 0.5 else 1
        self.wide, self.high = max(1.0, self.x1 - self.x0), max(1.0, self.y1 - self.y0)

    @cached_property
    def heading(self) -> bool:
        return len(self.flat) <= 96 and has("HEADING_LINE", self.flat)

    @cached_property
    def notation(self) -> bool:
        return self.flat != "" and (has("STRUCTURE_LINE", self.flat) or (len(self.flat) <= 140 and has("STRUCTURE_TOKEN", self.flat)))

    @cached_property
    def words(self) -> int:
        return words(self.flat)


def continues(a: str, b: str) -> bool:
    """predicates.continues over collapsed texts."""
    if not a or not b or has("LIST_ITEM", b):
        return False
    return b[0] in "=+-*/^_([{⊕←" or b[0].isdecimal() or unicodedata.category(b[0]) == "Ll" or a[-1] in "-=+*/^_⊕←,;:.([" or has("JOINER_END", a[-12:])


def mergeable(a: Fragment, b: Fragment, tallest: float) -> bool:
    """grouping.mergeable"""
    if a.half != b.half or max(a.high, b.high) > tallest or not a.flat or not b.flat:
        return False
    gap, shared = b.y0 - a.y1, max(0.0, min(a.x1, b.x1) - max(a.x0, b.x0)) / max(1.0, min(a.x1 - a.x0, b.x1 - b.x0))
    if shared < 0.68 or gap < -42.0 or gap > max(10.0, min(30.0, max(a.high, b.high) * 0.38 + 12.0)):
        return False
    goes_on = continues(a.flat, b.flat)
    narrow, left, right = max(1.0, min(a.wide, b.wide)), abs(a.x0 - b.x0), abs(a.x1 - b.x1)
    if gap < -2.5:
        if shared < 0.92 or not goes_on or left > max(34.0, narrow * 0.18) or right > max(190.0, narrow * 0.62):
            return False
    elif left > max(24.0, narrow * 0.10) or right > max(30.0, narrow * 0.12):
        return False
    if a.heading or b.heading or (gap >= -1.0 and (not goes_on or gap > 8.5) and (a.notation or b.notation)):
        return False
    return not ((a.high >= 44.0 and b.high >= 44.0 and a.words >= 18 and b.words >= 18) or (a.high > 72.0 and b.high > 72.0 and a.words > 55 and b.words > 55))


def merged(page: list[Fragment], most: int, tallest: float) -> list[list[Fragment]]:
    """The runs of following fragments that grouping.merge_fragments makes one block of."""
    out: list[list[Fragment]] = []
    top = 0.0
    before = None
    for b in sorted(page, key=lambda b: (b.half, b.block_index, b.y0, b.x0)):
        if before is not None and len(out[-1]) < most and max(before.y1, b.y1) - min(top, b.y0) <= tallest and mergeable(before, b, tallest):
            out[-1].append(b)
        else:
            out.append([b])
            top = b.y0
        before = b
    return out


def glued(parts: list[str]) -> str:
    """Stripped texts as one, a hyphen at the end of a part closed up."""
    out = ""
    for part in parts:
        if part and out:
            out = out[:-1].rstrip(" ") + part.lstrip(" ") if out.endswith("-") else f"{out}\n{part}"
        else:
            out = out or part
    return out


# Gates and what is set --------------------------------------------------------------------------------------------------


_FIRST = plain._java(r"[.!?;:]\s+")
_LISTED = plain._java(r"\s*\d{1,3}[\).]\s*")
_QUOTES = plain._java(r"['`‘’]+\s*")


def _share(n: int, part: float) -> int:
    return math.floor(n * part)


def has_meta(x: str) -> bool:
    if ("(" in x or "（" in x) and any(map(x.lower().__contains__, plain._INLINE_KEYS)) and plain._INLINE.search(x):
        return True
    return x != "" and plain.meta_line(x)


def extreme_length(s: Text, t: Text) -> bool:
    """quality.extreme_length"""
    n, m, w, zh = s.length, t.length, s.words, t.cjk
    if n == 0 or m == 0:
        return False
    marks = occurrences(t.flat, "。！？.;")
    if 4 <= w <= 28 and n <= 200 and zh >= max(70, w * 5) and m >= max(170, _share(n, 2.4)) and s.cjk <= 2 or s.n_lines <= 2 and n <= 140 and zh >= 80 and m >= 190 and marks >= 3:
        return True
    if n <= 260:
        si, ti = len(plain.items(s.text)), len(plain.items(t.text))
        if si >= 1 and ti > si and n <= 240 or si == 0 and ti >= 2 and n <= 180 and w >= 6 or si >= 1 and ti == 0 and w >= 6 and zh >= 6:
            return True
    if w >= 24 and n >= 240 and m <= max(30, _share(n, 0.20)) and zh <= max(20, _share(w, 0.55)) or w >= 55 and n >= 520 and m <= max(42, _share(n, 0.14)):
        return True
    low = s.lower
    return (
        (n <= 180 and w >= 5 and marks >= 3 and m >= _share(n, 1.65) and zh >= 72)
        or (n <= 130 and w >= 5 and zh >= 70 and m >= 150 and low.endswith(tuple(P.FRAGMENT_TAILS)))
        or (n <= 200 and marks >= 2 and zh >= 55 and m >= _share(n, 1.45) and (s.flat.endswith("-") or low.endswith((" and", " of"))))
        or (n <= 170 and w >= 8 and marks >= 2 and zh >= 42 and m >= _share(n, 1.18) and unicodedata.category(s.flat[0]) == "Ll")
    )


def large_segment(s: Text, t: Text, title: bool) -> bool:
    """quality.large_segment over a target of one line."""
    x = t.flat
    least, few = (24, 6) if title else (36, 8)
    n, zh = t.words, t.cjk
    if len(x) < least or n < few or zh > 2 or (zh >= 2 and _LISTED.match(x)):
        return False
    phrase = " ".join(plain.words(x)[:12]).lower()
    return (s.words >= 12 and n >= 10 and len(x) >= 60) or t.lower in s.lower or (len(phrase) >= 40 and phrase in s.lower)


def target_heading(x: str) -> bool:
    return x != "" and ((len(x) <= 28 and has("TARGET_HEADING", x)) or x.replace(" ", "") in P.TARGET_HEADINGS)


def low_quality(source: str | None, target: str | None) -> bool:
    """quality.judge, without lines."""
    if target is None:
        return True
    s, t = Text(collapse(source or "")), Text(collapse(target))
    if not s.flat:
        return False
    if not t.flat or s.lower == t.lower or has_meta(t.flat) or extreme_length(s, t):
        return True
    w, tw, zh = s.words, t.words, t.cjk
    title = s.title_block
    if w >= 10 and s.length >= 80 and not title and target_heading(t.flat):
        return True
    if title and ((tw >= max(6, _share(w, 0.45)) and zh < max(6, _share(w, 0.35))) or large_segment(s, t, True)):
        return True
    if w < 5:
        return w >= 2 and zh == 0 and tw >= max(2, w - 1)
    if tw >= max(8, _share(w, 0.55)) and zh < max(8, _share(w, 0.22)) and not (zh >= 8 and tw - J["ACRONYM"].count(t.flat) <= 3):
        return True
    if large_segment(s, t, False):
        return True
    if s.length >= 24 and zh >= 4 and s.lower in t.lower:
        return True
    first = _FIRST.split(s.lower, maxsplit=1)[0].strip()
    return len(first) >= 28 and first in t.lower


def facts(source: str | None) -> tuple[bool, int, int, int, int]:
    """What setting a translation needs of its source: whether lines are kept; length, words, items and marks of the collapsed text."""
    v = Text(source)
    return v.keeps_lines, v.length, v.words, len(plain.items(v.flat)), occurrences(v.flat, ",;:.?!，；：。")


def set_text(target: str, keeps: bool) -> str:
    """layout.render_text"""
    x = repaired(target.strip()).strip()
    if keeps:
        own = (_QUOTES.sub("", plain._RUN.sub(" ", s).strip(), count=1) if s[0] in "'`‘’" else plain._RUN.sub(" ", s) for s in lines(x))
        return "\n".join(s for s in own if not ((flat := collapse(s)) and plain._CONTINUED.match(flat)))
    return plain._RUN.sub(" ", _BREAK.sub(" ", x) if "\n" in x else x).strip()


def tight_box(n: int, en: int, n_items: int, target: str, height: float, width: float) -> str:
    """quality.tight_box; n, en and n_items are the source's length, words and items."""
    t = collapse(target)
    if n:
        at = plain.items(t)
        k = 1 if n_items <= 1 and len(at) >= 2 else n_items if n_items >= 2 and len(at) > n_items + 1 else None
        if k is not None and len(cut := t[: at[k]].rstrip(plain._TRAIL)) >= 8:
            t = cut
    if not n or not t:
        return t
    marks, out = occurrences(t, "。！？.;；"), t
    if height <= 42.0 and width >= 150.0 and en >= 6 and len(t) >= 56 and marks >= 1:
        small = plain.truncated(t, max(42, min(68, _share(n, 0.62))))
        if small and len(small) + 4 < len(t):
            out = small
    if n <= 220 and en >= 5 and len(t) >= max(125, _share(n, 1.45)) and marks >= 2 and cjk(t) >= 42:
        out = plain.truncated(out, max(108, _share(n, 1.3)))
    return out


#: The flags of plans.document.flagged, in their order; words and punct are numbers.
FLAGS = ["prose", "heading", "is_entry", "starts", "paragraph", "words", "punct", "fragment", "watermark", "algorithm", "algorithm_heading", "table_like", "caption", "note", "body", "contributions", "running", "entry", "table", "narrative", "wanted"]


def flags(text: str | None, y0: float, y1: float, page_height: float) -> tuple:
    v = Text(text)
    prose, starts, entry, paragraph, fragment = v.narrative_prose, v.starts > 0, v.reference_entry, v.paragraph_block, v.fragment
    caption, body = v.table_caption, v.table_body or v.table_header
    rows = v.rows[:2]
    note = "ote" in v.lower and has("TABLE_NOTE", v.text) if not v.odd else has("TABLE_NOTE", v.text)
    c = compact(v.text)
    return (
        prose, any(has("REFERENCE_HEADING", x) for x in rows), entry, starts, paragraph, v.words, v.punct, fragment, v.licence_watermark, v.algorithm_block, any(has("ALGORITHM_HEADING", x) for x in rows),
        v.table_like, caption, note, body, starts and v.contributions, v.running_header_footer(y0, y1, page_height), entry or starts, caption or body, paragraph or prose or fragment,
        (v if c == v.text else Text(c)).translatable,
    )


__all__ = ["FLAGS", "Fragment", "Text", "compact", "facts", "flags", "glued", "low_quality", "merged", "set_text", "tight_box"]
