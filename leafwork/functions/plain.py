"""The normalisation of a translation over one text, for Arrow batches: the rules of quality.steps_of_normalising as plain functions.

As Columns these steps decode and encode a text for each pattern and compute its lines anew for each use. Here a pattern runs
only where a character that it needs is there. Java's classes and ends are written out: its white space and its word
characters aren't those of Python. A test holds both forms against each other.
"""

from __future__ import annotations

import math
import re
import unicodedata

from . import patterns as P

_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TRAIL, _HARD, _SENTENCE = " ,;:.-，；：", " ,;:.-，；：", "。！？!?；;"
_LOOKALIKE, _REPAIRED = re.compile("[∗−′⁄⌈⌉⌊⌋Â]"), str.maketrans("∗−′⁄⌈⌉⌊⌋", "*-'/[][]", "Â")


def _word_class() -> str:
    """Letters, marks, decimal digits, connectors, joiners and circled letters, as Java's \\w has them under (?U)."""
    out, first = ["\u200c\u200d\U00020000-\U000323af\U000e0100-\U000e01ef"], None
    circled = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))
    for k in range(0x20001):
        c = unicodedata.category(chr(k)) if k < 0x20000 else "Cn"
        is_word = c[0] in "LM" or c in ("Nd", "Nl", "Pc") or any(a <= k <= b for a, b in circled)
        if is_word and first is None:
            first = k
        elif not is_word and first is not None:
            out.append(f"{chr(first)}-{chr(k - 1)}")
            first = None
    return "".join(out)


_WORD = _word_class()


def _java(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern whose \\s is Java's, with {<} for the start of a word and {>} for its end."""
    pattern = re.sub(r"(\[\^?)\\s", lambda m: m[1] + _BLANK, pattern).replace("\\s", f"[{_BLANK}]")
    return re.compile(pattern.replace("{<}", f"(?<![{_WORD}])").replace("{>}", f"(?![{_WORD}])"), flags)


_I = re.I
_LABEL = re.compile("译文：|翻译：")
_AFTER, _OPERATOR = re.compile("([,;:])(?=[A-Za-z])"), re.compile("([*=/<>≤≥±×÷])(?=[A-Za-z])")
_BOX = re.compile("(?<=[A-Za-z0-9])□(?=[A-Za-z0-9'*])")
_BODY = _java(r"\\\(\s*((?:.|\n){1,360}?)\s*\\\)|\\\[\s*((?:.|\n){1,480}?)\s*\\\]|\$\s*([^$]{1,360}?)\s*\$")
_SYMBOLS = [
    (_java((rf"(?:\\\s*|{{<}}){name}(?=\s*_\s*\{{?\s*R)|" if name.endswith("arrow") else "") + rf"\\\s*{name}{{>}}", _I), symbol)
    for name, symbol in {"leftarrow": "←", "rightarrow": "→", "oplus": "⊕", "times": "×", "cdot": "·", "leq": "≤", "geq": "≥", "neq": "≠", "in": "∈"}.items()
]
_RANDOM = _java(r"([←→])\s*_\s*\{?\s*R\s*\}?", _I)
_GROUP = _java(r"\\\s*(?:tex\s*t?|mathrm|operatorname)\s*\{([^{}]{1,80}?)\}|([_^])\s*\{([^{}]{1,40})\}", _I)
_ESCAPED = re.compile(r"\\([_{}])")
_TAG = _java(r"&lt;\s*/?\s*su[bp]{>}[^&]*&gt;|<\s*/?\s*su[bp]{>}[^>]*>", _I)
_MARK = _java(r"(?:(?<=\s)|^)\$(?=\s*[A-Za-z0-9(])|(?<=[A-Za-z0-9)])\$(?=\s|[，。,:;!?)]|\Z)|\\(?![nrt])(?=[\sA-Za-z一-鿿])")
_BY_AHEAD = r"(?=[+\-]?\d|(?:at|least|most){>}|[Ͱ-Ͽ一-鿿])"
_BY_HINT, _BY = _java(rf"by\s+{_BY_AHEAD}", _I), _java(rf"{{<}}([A-Za-z][A-Za-z0-9*']*)\s+by\s+{_BY_AHEAD}", _I)
_SEAM = _java(r"(?<=[=+\-*/<>≤≥])\s*;\s*(?=[A-Za-z0-9Ͱ-Ͽ])")
_RUN, _CONTROL = re.compile(r"[ \t]{2,}"), re.compile(P.CONTROL)
_PRIME = _java(r"{<}([A-Za-z])'\s+([A-Za-z])(?=\s*\()")
_SIGN, _SIGNED, _ENDING = _java(r"[+\-]\s*"), _java(r"[+\-]\s*[A-Za-z(]"), _java(r"\s+[+\-*/=]\s*\Z")
_STOPS, _ODD = re.compile("[。！？；，,]"), re.compile(r"[+\-*/=·•|]{1,4}")
_INLINE = re.compile(P.META_INLINE.removeprefix("(?iU)"), _I)
_INLINE_KEYS = ["后续内容保持原文", "严格遵循要求", "翻译要求", "输出要求", "不要输出", "不要翻译", "retry mode", "system prompt", "preferred terms", "mathseg"]
_LEAD = _java(r"\s*[.。·…]{2,}\s*")
_CONTINUED = _java(P.CONTINUATION_MARKER.removeprefix("(?iU)").replace("$", r"\Z"), _I)
_DOTS, _TOKEN = re.compile("[.。·…]{2,}"), re.compile(r"mathseg\d+token", _I)
_WORDS, _ACRONYMS = _java("{<}[A-Za-z]{3,}{>}"), _java("{<}[A-Z]{2,8}{>}")
_ASCII_WORDS = re.compile(r"\b[A-Za-z]{3,}\b", re.A)
_CJK = re.compile(P.CJK)
_NUMBERED = _java(r"\s*\d{1,3}[\).]\s*")
_ITEM_HINT, _ITEM = re.compile("\\d[）).、:：]"), _java(P.ITEM_MARKER.removeprefix("(?U)"))
_PIECES = _java(rf"(?<=[{_SENTENCE}])\s*")
_FRAGMENT_TAIL = _java(r"(?:{<}(?:for both the|for the|of the|and the|to the|in the|with the)|[,;:])\Z")
_NUMBER_ONLY = _java(r"(?:section\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+)\.?", _I)
_SECTION = re.compile(r"(?:Section +)?([IVXLCMivxlcm0-9\.]+) *[:.\-]? *([A-Za-z][A-Za-z \-]+)\Z")


def collapse(x: str) -> str:
    return " ".join(x.split())


def lines(x: str) -> list[str]:
    return [s for line in x.splitlines() if (s := line.strip())]


def words(x: str) -> list[str]:
    return (_ASCII_WORDS if x.isascii() else _WORDS).findall(x)


def cjk(x: str) -> int:
    return 0 if x.isascii() else len(_CJK.findall(x))


def occurrences(x: str, marks: str) -> int:
    return sum(map(x.count, marks))


def repair_unicode(x: str) -> str:
    if not x.isascii():
        x = (x.translate(_REPAIRED) if _LOOKALIKE.search(x) else x).replace("″", "''").replace("‴", "'''")
    x = _OPERATOR.sub(r"\1 ", _AFTER.sub(r"\1 ", x))
    return _BOX.sub("*", x).replace("□", "") if "□" in x else x


def residue_line(c: str) -> str | None:
    x = (_RUN.sub(" ", c) if "  " in c or "\t" in c else c).strip()
    x1 = _PRIME.sub(r"\1_\2", x) if "'" in x and "(" in x else x
    if x1[:1] in ("+", "-") and _SIGNED.match(x1) and "=" not in x1[:24] and (cjk(x1) or _STOPS.search(x1)):
        x1 = _SIGN.sub("", x1, count=1)
    if x1[-1:] in ("+", "-", "*", "/", "="):
        x1 = _ENDING.sub("", x1)
    x1 = x1.strip()
    return x1 if x and x1 and not _ODD.fullmatch(x) else None


def without_artefacts(x: str) -> str:
    x = repair_unicode(x)
    if "\\$" in x:
        x = x.replace("\\$", "$")
    if "$" in x or "\\(" in x or "\\[" in x:
        x = _BODY.sub(r"\1\2\3", x)
    if "\\" in x or "arrow" in x.lower():
        for pattern, symbol in _SYMBOLS:
            x = pattern.sub(symbol, x)
    if "←" in x or "→" in x:
        x = _RANDOM.sub(r"\1R", x)
    if "{" in x:
        x = _GROUP.sub(r"\1\2\3", x)
    if "\\" in x:
        x = _ESCAPED.sub(r"\1", x)
    if "<" in x or "&" in x:
        x = _TAG.sub("", x)
    if "$" in x or "\\" in x:
        x = _MARK.sub("", x)
    if _BY_HINT.search(x):
        x = _BY.sub(r"\1 ", x)
    if ";" in x:
        x = _SEAM.sub(" ", x)
    x = "\n".join(s for line in lines(repair_unicode(x)) if (s := residue_line(line)) is not None)
    return _RUN.sub(" ", _CONTROL.sub("", x)).strip()


def meta_line(c: str) -> bool:
    x = collapse(c)
    if len(x) <= 40 and _CONTINUED.match(x):
        return True
    if len(x) < 8:
        return bool(_DOTS.fullmatch(x))
    low = x.lower()
    if "mathseg" in low and _TOKEN.search(x):
        return True
    return any(k in low for k in P.META_KEYS) and (cjk(x) >= 4 or len(words(x)) >= 3)


def without_meta(c: str) -> str:
    x = c
    if ("(" in x or "（" in x) and any(map(x.lower().__contains__, _INLINE_KEYS)):
        x = _INLINE.sub("", x)
    x = x.strip()
    own = lines(x)
    kept = [s for s in own if not meta_line(s)]
    x = "\n".join(kept) if 0 < len(kept) < len(own) else x
    return x[m.end() :] if (m := _LEAD.match(x)) else x


class Source:
    """What the steps look at of a source: ``text`` as it is, and the rest of its collapsed form."""

    def __init__(self, text: str | None):
        self.null, self.text = text is None, text or ""
        self.flat = collapse(self.text)
        self.low = self.flat.lower()

    @property
    def word_set(self) -> set[str]:
        return set(words(self.low))


def left_in_english(s: Source, line: str, strict: bool) -> bool:
    x = collapse(line)
    if len(x) < (30 if strict else 22):
        return False
    zh, found = cjk(x), words(x)
    n = len(found)
    if zh > (1 if strict else 2) or n < (6 if strict else 5):
        return False
    if zh >= 2 and (n - len(_ACRONYMS.findall(x)) <= 2 or _NUMBERED.match(x)):
        return False
    if zh <= 1 and n >= 10 and len(x) >= 56:
        return True
    if len(s.low) < 20:
        return False
    low = x.lower()
    phrase = " ".join(found[: 12 if strict else 9]).lower()
    if low in s.low or (len(phrase) >= (36 if strict else 26) and phrase in s.low):
        return True
    own, theirs = s.word_set, set(words(low))
    return bool(own) and len(own & theirs) / max(1, len(theirs)) >= (0.62 if strict else 0.52)


def short_fragment(s: Source, line: str) -> bool:
    x = collapse(line)
    if not 15 <= len(x) <= 60 or s.low == "" or cjk(x) > 2:
        return False
    found, low = words(x), x.lower()
    return 3 <= len(found) <= 12 and ("," in x or low != x) and (low in s.low or any(w in s.low for w in found[:3]))


def without_echo_lines(s: Source, x: str) -> str:
    own = lines(x)
    if len(own) >= 2:
        kept = [line for line in own if not (len(collapse(line)) >= 16 and left_in_english(s, line, True))]
        if 0 < len(kept) < len(own):
            return "\n".join(kept)
    return x.strip()


def without_echo_prefix(s: Source, x: str) -> str:
    if len(s.flat) >= 16 and x.lower().startswith(s.low) and (tail := x[len(s.flat) :].lstrip(" \t\r\n:：-")):
        return tail
    return x


def without_residue(s: Source, x: str) -> str:
    own = lines(x)
    if len(own) < 2 or not any(cjk(line) >= 2 for line in own):
        return x
    kept = [line for line in own if not short_fragment(s, line) and not left_in_english(s, line, False)]
    return "\n".join(kept) if 0 < len(kept) < len(own) else x


def truncated(c: str, limit: int) -> str:
    x = c.strip()
    if len(x) <= limit:
        return x
    pieces = [s for piece in _PIECES.split(x) if (s := piece.strip())]
    out, n = [], 0
    for s in pieces:
        if n >= limit or (n > 0 and n + len(s) > limit):
            break
        out.append(s)
        n += len(s)
    return "".join(out) if pieces else x[:limit].rstrip(_HARD)


def items(x: str) -> list[int]:
    """0-based places of the markers of numbered items."""
    return [m.start(1) for m in _ITEM.finditer(x)] if _ITEM_HINT.search(x) else []


def trimmed_items(s: Source, x: str) -> str:
    t = x.strip()
    at = items(t)
    if len(at) >= 2:
        n = len(items(s.text))
        k = 1 if n <= 1 else n if len(at) > n + 1 else None
        if k is not None and len(cut := t[: at[k]].rstrip(_TRAIL)) >= 8:
            return cut
    return t


def trimmed_fragment(s: Source, x: str) -> str:
    t, n = x.strip(), len(s.flat)
    if not s.flat or not t or n > 240:
        return t
    zh, marks = cjk(t), occurrences(t, "。！？.;；")
    if n <= 180 and zh >= 80 and len(t) >= math.floor(n * 1.6) and marks >= 3 and len(words(s.flat)) >= 5:
        return truncated(t, max(120, math.floor(n * 1.55)))
    if n <= 200 and zh >= 56 and len(t) >= math.floor(n * 1.45) and marks >= 2 and (s.flat.endswith("-") or _FRAGMENT_TAIL.search(s.low)):
        return truncated(t, max(108, math.floor(n * 1.35)))
    return t


def section_heading(s: Source) -> str | None:
    m = _SECTION.match(s.flat)
    found = m and P.SECTION_HEADINGS.get(collapse(m[2]).upper())
    return f"{m[1]} {found}" if found else None


def capped(s: Source, x: str) -> str:
    n = len(s.text.strip())
    if s.null or n > 220:
        return x
    if n <= 80:
        one = collapse(x)
        if _NUMBER_ONLY.fullmatch(one):
            one = section_heading(s) or one
        most = max(80, n * 3)
        return one[:most].rstrip(" ,;:.-") if len(one) > most else one
    wide = max(150, math.floor(n * 1.8))
    return truncated(x, wide) if len(x) > wide and len(words(s.text)) <= 42 else x


def normalised(source: str | None, target: str | None, rule: str | None) -> str | None:
    """rule: what the first rule that matches the source says, which stands in the place of all that is found until then."""
    s, x = Source(source), (target or "").strip()
    if "：" in x:
        x = _LABEL.sub("", x).strip()
    x = without_meta(without_artefacts(x if x.isascii() else unicodedata.normalize("NFKC", x)))
    x = without_residue(s, without_echo_prefix(s, without_echo_lines(s, x)))
    x = trimmed_fragment(s, trimmed_items(s, x if rule is None else rule))
    x = capped(s, without_meta(without_artefacts(x)))
    return target if x == "" else x


__all__ = ["normalised"]
