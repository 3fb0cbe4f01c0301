"""Quality gates for translations and their repair, as Column expressions over a source and a translated text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P
from . import plain
from . import predicates as is_
from .text import (
    View, all_of, any_of, cjk, collapse, contains_any, count, decide, first_sentence, item_count, item_positions, lines, matches, occurrences, repair_unicode, strip, sub, truncated, with_view, words, word_set,
)

NO, YES = False, True
_TRAIL = " ,;:.-，；："


def _share(n: Column, part: float) -> Column:
    """int(n * part)"""
    return F.floor(n * part).cast("int")


def _at_least(base: int, x: Column) -> Column:
    return F.greatest(F.lit(base), x)


def echo(source: Column, target: Column) -> Column:
    """The translation is the source again, or mostly so."""
    s, t = F.lower(collapse(source)), F.lower(collapse(target))
    sw, tw = words(s), words(t)
    own, theirs = word_set(s), word_set(t)
    common = F.size(F.array_intersect(own, theirs)) / F.greatest(F.lit(1), F.size(theirs))
    return decide(
        ((s == "") | (t == ""), NO),
        (s == t, count(collapse(source), P.LATIN) >= 10),
        ((sw < 3) | (tw < 4) | (cjk(t) >= 4), NO),
        (s.contains(t) | t.contains(s), YES),
        otherwise=(sw >= 8) & (common >= 0.82) & (tw >= _at_least(6, _share(sw, 0.7))),
    )


def batch_echo(bad: Column, n: Column) -> Column:
    """Whether a batch has too many echoes; bad and n are aggregates of it."""
    return (bad > 0) & ((n == 1) | (bad >= _at_least(2, F.floor(n / 2).cast("int"))))


def extreme_length(source: View, target: View) -> Column:
    """Lengths that no translation has: fragments that grow to paragraphs, paragraphs that shrink to a phrase, items gone or new."""
    s, t = source, target
    marks = occurrences(t.flat, "。！？.;")
    si, ti = item_count(s.text), item_count(t.text)
    grown = lambda part: t.length >= _share(s.length, part)
    tail = any_of(*(s.lower.endswith(x) for x in P.FRAGMENT_TAILS))
    cut_off = s.flat.endswith("-") | s.lower.endswith(" and") | s.lower.endswith(" of")
    return (s.flat != "") & (t.flat != "") & any_of(
        (s.cjk <= 2) & s.words.between(4, 28) & (s.length <= 200) & (t.cjk >= _at_least(70, s.words * 5)) & (t.length >= _at_least(170, _share(s.length, 2.4))),
        (s.n_lines <= 2) & (s.length <= 140) & (t.cjk >= 80) & (t.length >= 190) & (marks >= 3),
        (si >= 1) & (ti > si) & (s.length <= 240),
        (si == 0) & (ti >= 2) & (s.length <= 180) & (s.words >= 6),
        (si >= 1) & (ti == 0) & (s.length <= 260) & (s.words >= 6) & (t.cjk >= 6),
        (s.words >= 24) & (s.length >= 240) & (t.length <= _at_least(30, _share(s.length, 0.20))) & (t.cjk <= _at_least(20, _share(s.words, 0.55))),
        (s.words >= 55) & (s.length >= 520) & (t.length <= _at_least(42, _share(s.length, 0.14))),
        (s.length <= 180) & (s.words >= 5) & (marks >= 3) & grown(1.65) & (t.cjk >= 72),
        (s.length <= 130) & (s.words >= 5) & tail & (t.cjk >= 70) & (t.length >= 150),
        (s.length <= 200) & cut_off & (marks >= 2) & (t.cjk >= 55) & grown(1.45),
        (s.length <= 170) & (s.words >= 8) & matches(s.flat, r"\A\p{Ll}") & (marks >= 2) & (t.cjk >= 42) & grown(1.18),
    )


def meta_line(c: Column) -> Column:
    """A line that the prompt leaked, not the paper."""
    x = collapse(c)
    keyed = contains_any(F.lower(x), P.META_KEYS) & ((cjk(x) >= 4) | (words(x) >= 3))
    marker = matches(x, P.CONTINUATION_MARKER)
    return F.when(F.length(x) < 8, matches(x, P.DOTS) | marker).otherwise(marker | matches(x, P.MATH_TOKEN) | keyed)


def has_meta(c: Column) -> Column:
    return matches(c, P.META_INLINE) | F.exists(lines(c), meta_line)


def without_meta(c: Column) -> Column:
    x = strip(sub(c, P.META_INLINE))
    own = lines(x)
    kept = F.filter(own, lambda s: ~meta_line(s))
    cut = F.when((F.size(kept) > 0) & (F.size(kept) < F.size(own)), F.array_join(kept, "\n")).otherwise(x)
    return sub(cut, r"(?U)^\s*[.。·…]{2,}\s*")


def left_in_english(source: Column, line: Column, strict: bool) -> Column:
    """A line of a translation that was probably not translated."""
    x = collapse(line)
    n, zh, acronyms = words(x), cjk(x), count(x, P.ACRONYM)
    s, low = F.lower(collapse(source)), F.lower(x)
    phrase = F.lower(F.array_join(F.slice(F.regexp_extract_all(x, F.lit(P.WORD), F.lit(0)), 1, 12 if strict else 9), " "))
    own, theirs = word_set(s), word_set(x)
    common = F.size(F.array_intersect(own, theirs)) / F.greatest(F.lit(1), F.size(theirs))
    return decide(
        ((F.length(x) < (30 if strict else 22)) | (zh > (1 if strict else 2)) | (n < (6 if strict else 5)), NO),
        ((zh >= 2) & ((n - acronyms <= 2) | matches(x, r"(?U)^\s*\d{1,3}[\).]\s*")), NO),
        ((zh <= 1) & (n >= 10) & (F.length(x) >= 56), YES),
        (F.length(s) < 20, NO),
        (s.contains(low) | ((F.length(phrase) >= (36 if strict else 26)) & s.contains(phrase)), YES),
        otherwise=(F.size(own) > 0) & (common >= (0.62 if strict else 0.52)),
    )


def residue(source: Column, target: Column) -> Column:
    """English lines in an otherwise Chinese text: two of them, or eight words."""
    own = lines(target)
    left = F.filter(own, lambda x: left_in_english(source, x, False))
    n = F.aggregate(left, F.lit(0), lambda a, x: a + words(x))
    return (F.size(own) >= 2) & F.exists(own, lambda x: cjk(x) >= 2) & ((n >= 8) | (F.size(left) >= 2))


def short_fragment(source: Column, line: Column) -> Column:
    x = collapse(line)
    found = F.regexp_extract_all(x, F.lit(P.WORD), F.lit(0))
    s = F.lower(source)
    known = s.contains(F.lower(x)) | F.exists(F.slice(found, 1, 3), lambda w: s.contains(w))
    return (cjk(x) <= 2) & F.size(found).between(3, 12) & F.length(x).between(15, 60) & (x.contains(",") | (F.lower(x) != x)) & (s != "") & known


def without_residue(source: Column, target: Column) -> Column:
    own = lines(target)
    kept = F.filter(own, lambda x: ~short_fragment(source, x) & ~left_in_english(source, x, False))
    changed = (F.size(own) >= 2) & F.exists(own, lambda x: cjk(x) >= 2) & (F.size(kept) > 0) & (F.size(kept) < F.size(own))
    return F.when(changed, F.array_join(kept, "\n")).otherwise(target)


def echo_line(source: Column, line: Column) -> Column:
    return (F.length(collapse(line)) >= 16) & left_in_english(source, line, True)


def without_echo_lines(source: Column, target: Column) -> Column:
    own = lines(target)
    kept = F.filter(own, lambda x: ~echo_line(source, x))
    return F.when((F.size(own) >= 2) & (F.size(kept) > 0) & (F.size(kept) < F.size(own)), F.array_join(kept, "\n")).otherwise(strip(target))


def without_echo_prefix(source: Column, target: Column) -> Column:
    tail = F.ltrim(F.substring(target, F.length(source) + 1, F.length(target)), F.lit(" \t\r\n:：-"))
    return F.when((F.length(source) >= 16) & F.lower(target).startswith(F.lower(source)) & (tail != ""), tail).otherwise(target)


def large_segment(source_lower: Column, target: Column, source_words: Column, title: bool) -> Column:
    """A long stretch of English in the translation."""
    least, few = (24, 6) if title else (36, 8)

    def bad(line: Column) -> Column:
        x = collapse(line)
        n, zh = words(x), cjk(x)
        phrase = F.lower(F.array_join(F.slice(F.regexp_extract_all(x, F.lit(P.WORD), F.lit(0)), 1, 12), " "))
        item = matches(x, r"(?U)^\s*\d{1,3}[\).]\s*") & (zh >= 2)
        whole = (source_words >= 12) & (n >= 10) & (F.length(x) >= 60)
        return (F.length(x) >= least) & (n >= few) & (zh <= 2) & ~item & (whole | source_lower.contains(F.lower(x)) | ((F.length(phrase) >= 40) & source_lower.contains(phrase)))

    return F.exists(lines(target), bad)


def low_quality(s: View, t: View, target: Column | None = None) -> Column:
    """Whether a translation must not be used, over views of the collapsed texts.

    So tests of lines see one line; with target, residue is looked for in its lines as they are.
    """
    title = is_.title_block(s)
    acronyms = count(t.flat, P.ACRONYM)
    relieved = (F.greatest(F.lit(0), t.words - acronyms) <= 3) & (t.cjk >= 8)
    first = first_sentence(s.lower)
    return decide(
        (s.flat == "", NO),
        (t.flat == "", YES),
        (has_meta(t.flat) | residue(s.flat, t.flat if target is None else target) | extreme_length(s, t) | (s.lower == t.lower), YES),
        ((s.words >= 10) & (s.length >= 80) & ~title & is_.target_heading(t.flat), YES),
        (title & (((t.words >= _at_least(6, _share(s.words, 0.45))) & (t.cjk < _at_least(6, _share(s.words, 0.35)))) | large_segment(s.lower, t.flat, s.words, True)), YES),
        (s.words < 5, (s.words >= 2) & (t.cjk == 0) & (t.words >= _at_least(2, s.words - 1))),
        (~relieved & (t.words >= _at_least(8, _share(s.words, 0.55))) & (t.cjk < _at_least(8, _share(s.words, 0.22))), YES),
        (large_segment(s.lower, t.flat, s.words, False), YES),
        otherwise=((s.length >= 24) & t.lower.contains(s.lower) & (t.cjk >= 4)) | ((F.length(first) >= 28) & t.lower.contains(first)),
    )


def judge(df: DataFrame, source: str, target: str, out: str = "low_quality", strict_lines: bool = False) -> DataFrame:
    """df with ``out``: whether the translation must not be used; a null one must not. The texts' views are computed once."""
    df = df.withColumns({"_js": collapse(F.coalesce(source, F.lit(""))), "_jt": collapse(F.coalesce(target, F.lit("")))})
    df, s = with_view(df, "_js", "_js_")
    df, t = with_view(df, "_jt", "_jt_")
    df = df.withColumn(out, F.col(target).isNull() | low_quality(s, t, F.col(target) if strict_lines else None))
    return df.drop("_js", "_jt", *(c for c in df.columns if c.startswith(("_js_", "_jt_"))))


def trimmed_items(source: Column, target: Column) -> Column:
    """Without numbered items beyond the source's."""
    t = strip(target)
    n, at = item_count(source), item_positions(t)
    k = F.when((n <= 1) & (F.size(at) >= 2), F.lit(1)).when((n >= 2) & (F.size(at) > n + 1), n)
    cut = F.rtrim(F.substring(t, F.lit(1), F.get(at, k)), F.lit(_TRAIL))
    return F.when(k.isNotNull() & (F.length(cut) >= 8), cut).otherwise(t)


def trimmed_fragment(source: Column, target: Column) -> Column:
    s, t = collapse(source), strip(target)
    n, marks = F.length(s), occurrences(t, "。！？.;；")
    tail = s.endswith("-") | matches(F.lower(s), P.FRAGMENT_TAIL)
    long_ = (words(s) >= 5) & (n <= 180) & (cjk(t) >= 80) & (F.length(t) >= _share(n, 1.6)) & (marks >= 3)
    frag = tail & (n <= 200) & (cjk(t) >= 56) & (F.length(t) >= _share(n, 1.45)) & (marks >= 2)
    return decide(
        ((s == "") | (t == "") | (n > 240), t),
        (long_, truncated(t, _at_least(120, _share(n, 1.55)))),
        (frag, truncated(t, _at_least(108, _share(n, 1.35)))),
        otherwise=t,
    )


def tight_box(df: DataFrame, source: str, target: str, height: Column, width: Column, out: str) -> DataFrame:
    """df with ``out``: a translation cut to suit a low box. Each cut is a projection."""
    df = df.withColumns({"_s": collapse(F.col(source)), "_t": collapse(F.col(target))})
    df = df.withColumn("_t", F.when(F.col("_s") == "", F.col("_t")).otherwise(trimmed_items(F.col("_s"), F.col("_t"))))
    s, t, t2 = F.col("_s"), F.col("_t"), F.col("_t2")
    df = df.withColumns({"_n": F.length(s), "_en": words(s), "_marks": occurrences(t, "。！？.;；")})
    n, en, marks = F.col("_n"), F.col("_en"), F.col("_marks")
    df = df.withColumn("_small", truncated(t, F.greatest(F.lit(42), F.least(F.lit(68), _share(n, 0.62)))))
    low = (height <= 42.0) & (width.isNull() | (width >= 150.0)) & (en >= 6) & (F.length(t) >= 56) & (marks >= 1) & (F.col("_small") != "") & (F.length("_small") + 4 < F.length(t))
    df = df.withColumn("_t2", F.when(F.coalesce(low, F.lit(False)), F.col("_small")).otherwise(t))
    long_ = (n <= 220) & (en >= 5) & (cjk(t) >= 42) & (F.length(t) >= _at_least(125, _share(n, 1.45))) & (marks >= 2)
    df = df.withColumn(out, F.when((s == "") | (t == ""), t).when(long_, truncated(t2, _at_least(108, _share(n, 1.3)))).otherwise(t2))
    return df.drop("_s", "_t", "_t2", "_n", "_en", "_marks", "_small")


#: Commands, and the symbols that stand for them.
SYMBOLS = {"leftarrow": "←", "rightarrow": "→", "oplus": "⊕", "times": "×", "cdot": "·", "leq": "≤", "geq": "≥", "neq": "≠", "in": "∈"}
#: The longest content of inline and display formulas, of named groups and of scripts.
_INLINE, _DISPLAY, _NAMED, _SCRIPT = 360, 480, 80, 40


def _opened(x: Column) -> Column:
    """Formulas without their delimiters."""
    bodies = [rf"\\\(\s*([\s\S]{{1,{_INLINE}}}?)\s*\\\)", rf"\\\[\s*([\s\S]{{1,{_DISPLAY}}}?)\s*\\\]", rf"\$\s*([^$]{{1,{_INLINE}}}?)\s*\$"]
    return sub(sub(x, r"\\\$", r"\$"), "(?U)" + "|".join(bodies), "$1$2$3")


def _ungrouped(x: Column) -> Column:
    """Braces of text commands and of scripts, with their content only; escaped braces and underscores as they are."""
    x = sub(x, rf"(?iU)\\\s*(?:tex\s*t?|mathrm|operatorname)\s*\{{([^{{}}]{{1,{_NAMED}}}?)\}}|([_^])\s*\{{([^{{}}]{{1,{_SCRIPT}}})\}}", "$1$2$3")
    return sub(x, r"\\([_{}])", "$1")


def _symbols(x: Column) -> Column:
    """Commands as symbols. An arrow with the subscript R, for a random choice, needs no backslash and loses the underscore."""
    for name, symbol in SYMBOLS.items():
        drawn = rf"(?:\\\s*|\b){name}(?=\s*_\s*\{{?\s*R)|" if name.endswith("arrow") else ""
        x = sub(x, rf"(?iU){drawn}\\\s*{name}\b", symbol)
    return sub(x, r"(?iU)([←→])\s*_\s*\{?\s*R\s*\}?", "$1R")


def _unmarked(x: Column) -> Column:
    """Without script tags, and without dollars and backslashes that belong to nothing."""
    x = sub(x, r"(?iU)&lt;\s*/?\s*su[bp]\b[^&]*&gt;|<\s*/?\s*su[bp]\b[^>]*>")
    before, behind, escape = r"(?:(?<=\s)|^)\$(?=\s*[A-Za-z0-9(])", r"(?<=[A-Za-z0-9)])\$(?=\s|[，。,:;!?)]|$)", r"\\(?![nrt])(?=[\sA-Za-z一-鿿])"
    return sub(x, f"(?U){before}|{behind}|{escape}")


def _seams(x: Column) -> Column:
    """What translations leave between a formula and its words: ``x by 至少``, an operator before a semicolon."""
    x = sub(x, r"(?iU)\b([A-Za-z][A-Za-z0-9*']*)\s+by\s+(?=[+\-]?\d|(?:at|least|most)\b|[Ͱ-Ͽ一-鿿])", "$1 ")
    return sub(x, r"(?U)(?<=[=+\-*/<>≤≥])\s*;\s*(?=[A-Za-z0-9Ͱ-Ͽ])", " ")


def residue_line(c: Column) -> Column:
    """A line without what broken math delimiters leave; null to drop it."""
    x = strip(sub(c, r"[ \t]{2,}", " "))
    x1 = sub(x, r"(?U)\b([A-Za-z])'\s+([A-Za-z])(?=\s*\()", "$1_$2")
    prose = (cjk(x1) > 0) | matches(x1, "[。！？；，,]")
    x2 = F.when(matches(x1, r"(?U)^[+\-]\s*[A-Za-z(]") & prose & ~F.substring(x1, 1, 24).contains("="), sub(x1, r"(?U)^[+\-]\s*")).otherwise(x1)
    x3 = strip(sub(x2, r"(?U)\s+[+\-*/=]\s*$"))
    return F.when((x != "") & ~matches(x, r"\A[+\-*/=·•|]{1,4}\z") & (x3 != ""), x3)


def without_artefacts(c: Column, composed: Column | None = None) -> Column:
    """Without LaTeX, HTML and delimiter residue."""
    x = repair_unicode(c, composed)
    for step in (_opened, _symbols, _ungrouped, _unmarked, _seams):
        x = step(x)
    x = repair_unicode(x, x)
    x = F.array_join(F.filter(F.transform(lines(x), residue_line), lambda s: s.isNotNull()), "\n")
    return strip(sub(sub(x, P.CONTROL), r"[ \t]{2,}", " "))


def section_heading(source: Column) -> Column:
    """The translated heading of a common section, with its number; null for others."""
    pattern = r"^(?:Section\s+)?([IVXLCMivxlcm0-9\.]+)\s*[:.\-]?\s*([A-Za-z][A-Za-z \-]+)$"
    s = collapse(source)
    number, title = F.regexp_extract(s, pattern, 1), F.upper(collapse(F.regexp_extract(s, pattern, 2)))
    known = F.create_map(*(F.lit(x) for kv in P.SECTION_HEADINGS.items() for x in kv))
    found = F.try_element_at(known, title)
    return F.when((number != "") & found.isNotNull(), F.concat(number, F.lit(" "), found))


def short_phrase(source: Column) -> Column:
    """The translation of a stock phrase around formulas; null for others."""
    s = collapse(source)
    n = words(s)
    known = F.create_map(*(F.lit(x) for kv in P.SHORT_PHRASES.items() for x in kv))
    found = F.try_element_at(known, collapse(F.lower(sub(s, "[^A-Za-z ]", " "))))
    usable = (s != "") & (cjk(s) == 0) & n.between(2, 8) & (F.length(s) <= 72)
    return F.when(usable, F.when(s.endswith(":") | s.endswith("："), F.concat(found, F.lit("："))).otherwise(found))


def rule_table(rules: list[tuple[str, str]], source: Column) -> Column:
    """The translation of the first rule whose pattern matches the collapsed source; null for none.

    For titles and table sentences of a corpus: what stands in such rules is data of the user, not of this library.
    """
    s = collapse(source)
    return F.coalesce(*(F.when(matches(s, p), F.lit(to)) for p, to in rules)) if rules else F.lit(None).cast("string")


def steps_of_normalising(rules: list[tuple[str, str]] | None = None) -> list:
    """The normalisation of a translation as functions of (source, text so far), to be applied one after another."""
    number_only = r"(?iU)\A(?:section\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+)\.?\z"

    def caps(source: Column, x: Column) -> Column:
        n = F.length(strip(source))
        one = collapse(x)
        one = F.when(matches(one, number_only), F.coalesce(section_heading(source), one)).otherwise(one)
        most = _at_least(80, n * 3)
        short = F.when(F.length(one) > most, F.rtrim(F.substring(one, F.lit(1), most), F.lit(" ,;:.-"))).otherwise(one)
        wide = _at_least(150, _share(n, 1.8))
        return F.when(n <= 80, short).when((n <= 220) & (words(source) <= 42) & (F.length(x) > wide), truncated(x, wide)).otherwise(x)

    return [
        lambda s, x: strip(sub(strip(x), "译文：|翻译：")),
        lambda s, x: without_artefacts(x),
        lambda s, x: without_meta(x),
        without_echo_lines,
        without_echo_prefix,
        without_residue,
        lambda s, x: F.coalesce(rule_table(rules or [], s), x),
        trimmed_items,
        trimmed_fragment,
        lambda s, x: without_artefacts(x, x),
        lambda s, x: without_meta(x),
        caps,
    ]


@F.pandas_udf(T.StringType())
def _normalised(source: pd.Series, target: pd.Series, rule: pd.Series) -> pd.Series:
    given = ((None if pd.isna(x) else x for x in c) for c in (source, target, rule))
    return pd.Series([plain.normalised(*x) for x in zip(*given)], dtype=object)


def normalise(df, source: str, target: str, out: str = "normalised", rules: list[tuple[str, str]] | None = None):
    """df with ``out``: the translation without labels, artefacts, leaked prompts, echoes and overlong parts.

    Where nothing would be left, the translation stays as it was. Rules are matched here, as their patterns are Java's.
    """
    return df.withColumn(out, _normalised(F.col(source), F.col(target), rule_table(rules or [], F.col(source))))


def normalise_by_columns(df, source: str, target: str, out: str = "normalised", rules: list[tuple[str, str]] | None = None):
    """normalise by Column expressions alone; a step is a projection. Many times slower: the measure of the plain functions."""
    df = df.withColumns({"_x": F.coalesce(F.col(target), F.lit("")), "_src": collapse(F.coalesce(F.col(source), F.lit("")))})
    echoes = (without_echo_lines, without_echo_prefix, without_residue)
    for step in steps_of_normalising(rules):
        df = df.withColumn("_x", step(F.col("_src") if step in echoes else F.col(source), F.col("_x")))
    return df.withColumn(out, F.when(F.col("_x") == "", F.col(target)).otherwise(F.col("_x"))).drop("_x", "_src")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("all_of", "annotations")]
