"""What a piece of text is: predicates over a View, all of them Column expressions.

Each predicate is a list of rules; the first that holds decides. Thresholds are fixed values of the data model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import View, all_of, any_of, cjk, collapse, contains_any, count, decide, hits, matches, occurrences, ratio, staged, strip, view, words

YES, NO = True, False

#: A hyphen or slash counts as an operator next to a digit, a bracket, a space, an end, or another operator.
#: The look ahead passes over letters and spaces quickly.
_MATH_SYMBOL = "(?![a-zA-Z0-9 ])(?:[" + P.MATH_CHARS + r"]|[=+*^_<>]|(?:(?<=[\d)\]} _=+*/^<>-])|(?<![\s\S]))[-/]|[-/](?=[\d(\[{ _=+*/^<>-]|(?![\s\S])))"


def math_symbols(c: Column) -> Column:
    return count(c, _MATH_SYMBOL)


def short_tokens(c: Column) -> Column:
    return count(c, P.SHORT_TOKEN)


def formula(c: Column) -> Column:
    """An assignment, LaTeX, a call, or many operators with little else."""
    return _formula(strip(c), math_symbols(strip(c)))


def _formula(x: Column, n: Column) -> Column:
    size = F.length(x)
    return (x != "") & any_of(
        (n >= 2) & (size <= 220) & ((count(x, r"(?U)\d") >= 1) | (short_tokens(x) >= 3)),
        (n >= 2) & (size <= 180) & (words(x) <= 5),
        matches(x, P.FORMULA),
        matches(x, P.LATEX_COMMAND),
        (size <= 160) & matches(x, P.CALL),
    )


def formula_line(c: Column) -> Column:
    return _formula_line(strip(c), math_symbols(strip(c)))


def _formula_line(x: Column, n: Column) -> Column:
    """x: the stripped line, n: its operators."""
    return (x != "") & any_of(
        (n >= 3) & (F.length(x) <= 260) & (n / F.length(x) >= 0.08),
        _formula(x, n),
        (n >= 1) & matches(x, P.OPTIMUM),
        matches(x, P.DISPLAY_EQUATION) & matches(x, P.MATH_STRUCTURE),
    )


@staged
def line_facts(v: View) -> Column:
    """For each line: whether it is a formula, and its words. Two steps, so that nothing is counted twice."""
    counted = F.transform(v.lines, lambda x: F.struct(x.alias("x"), math_symbols(x).alias("n"), words(x).alias("words")))
    return F.transform(counted, lambda s: F.struct(_formula_line(s["x"], s["n"]).alias("formula"), s["words"].alias("words")))


@staged
def formula_narrative(v: View) -> Column:
    """Prose about formulas."""
    n, hints = math_symbols(v.flat), count(v.flat, P.NARRATIVE_HINT)
    lead, hint = matches(v.flat, P.PROSE_LEAD), matches(v.flat, P.PROSE_HINT)
    few = (v.words < 3) & (count(v.flat, P.ANY_WORD) >= 2) & (n >= 1) & (lead | hint)
    many = (v.words >= 3) & any_of(hints >= 2, lead & (n >= 1), hint & (n >= 1) & (v.words >= 4), (hints >= 1) & (occurrences(v.flat, ",;:") >= 1) & (v.words >= 5))
    return (v.n_lines > 0) & (few | many)


@staged
def formula_block(v: View) -> Column:
    facts = line_facts(v)
    found = F.size(F.filter(facts, lambda x: x["formula"]))
    prose = F.filter(facts, lambda x: ~x["formula"] & (x["words"] >= 6))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["words"])
    return decide(
        ((v.n_lines < 2) | (found == 0), NO),
        ((total(prose) >= 8) | formula_narrative(v) | (total(facts) >= 10), NO),
        otherwise=(found >= 2) | ((v.n_lines <= 4) & (F.size(prose) <= 1)),
    )


@staged
def formula_narrative_fragment(v: View) -> Column:
    return (v.words >= 4) & matches(v.flat, P.FRAGMENT_VERB) & (matches(v.flat, r"[=<>≤≥+\-*/^_()]") | matches(v.flat, P.FRAGMENT_NOUN))


@staged
def standalone_caption(v: View) -> Column:
    upper = ratio(count(v.flat, r"\p{Lu}"), count(v.flat, r"\p{L}"))
    that, comma = v.lower.contains(" that "), v.flat.contains(",")
    return decide(
        (~matches(v.flat, P.CAPTION), NO),
        ((v.words >= 6) & matches(v.lower, P.TABLE_VERB), NO),
        (v.words >= 36, NO),
        ((v.punct >= 2) & (v.words >= 14), NO),
        ((v.words >= 12) & (v.punct >= 1) & (comma | that | v.lower.contains(" which ") | v.lower.contains(" including ")), NO),
        ((v.words >= 8) & (that | v.lower.contains(" since ") | comma), NO),
        otherwise=(v.words <= 12) | (upper >= 0.55),
    )


@staged
def skipped(v: View) -> Column:
    """Text that needs no translation: numbers, urls, citations, captions, code, formulas."""
    x = strip(v.text)
    narrative, hint = formula_narrative(v), matches(x, P.PROSE_HINT)
    theorem = matches(x, P.THEOREM) & (v.words >= 4)
    symbols = ratio(count(x, r"(?U)[^\p{L}\p{N}\s]"), F.length(x))
    return decide(
        ((x == "") | matches(x, r"(?U)\A[\d\W_]+\z"), YES),
        (matches(x, P.URL) | matches(x, P.CITATION) | standalone_caption(v), YES),
        (matches(x, P.CODE) & (occurrences(x, " ") < 40) & (v.words < 6), ~narrative),
        (formula_block(v), ~(theorem | narrative)),
        ((symbols > 0.35) & (v.words < 10), ~(narrative | ((v.words >= 4) & hint))),
        (formula(x), ~(theorem | narrative | ((v.words >= 4) & hint) | (v.words >= 6))),
        otherwise=NO,
    )


def translatable(compacted: View) -> Column:
    """Over a view of the compacted text: not skipped, and not Chinese already."""
    v = compacted
    return (v.flat != "") & ~skipped(v) & ~any_of((v.words == 0) & (v.cjk > 0), (v.cjk >= 16) & (v.words <= 2), (v.cjk >= 48) & (v.words <= 5) & (v.latin <= 28))


def force_retry(compacted: View) -> Column:
    v = compacted
    mixed = ((v.words >= 10) & (v.latin >= 40)) | ((v.cjk <= 20) & (v.words >= 6) & (v.latin >= 24))
    plain = (v.words >= 6) | matches(v.text, r"(?iU)^\s*(?:section\s+)?\d+(?:\.\d+)*\s+[A-Za-z]") | ((F.length(v.text) <= 80) & (v.words >= 2))
    return (v.flat != "") & ~skipped(v) & F.when(v.cjk > 0, mixed).otherwise(plain)


@staged
def licence_watermark(v: View) -> Column:
    signals = hits(*(v.lower.contains(s) for s in P.LICENCE_SIGNALS), v.lower.contains("republication/redistribution") | v.lower.contains("republication redistribution"), matches(v.flat, P.LICENCE))
    return v.lower.contains("authorized licensed use limited to") | ((signals >= 3) & (v.length <= 420))


def running_header_footer(v: View, y0: Column, y1: Column, page_height: Column) -> Column:
    letters, number = count(v.flat, r"\p{L}"), matches(v.flat, r"(?U)\A\d{1,5}\z")
    some_number = matches(v.flat, r"(?U)\b\d{3,5}\b")
    top = any_of(
        matches(v.flat, P.HEADER_HINT),
        number,
        (v.length <= 42) & (v.words <= 6) & (F.upper(v.flat) == v.flat) & (letters > 0),
        (v.length <= 180) & matches(v.lower, r"(?U)\bet al\.:") & some_number,
        (letters >= 10) & some_number & (ratio(count(v.flat, r"\p{Lu}"), letters) >= 0.42) & v.flat.contains(":"),
    )
    bottom = any_of(licence_watermark(v), matches(v.flat, P.FOOTER_HINT), number, (v.length <= 56) & (v.words <= 7) & (v.lower.contains("downloaded on") | v.lower.contains("ieee xplore")))
    return (page_height > 0) & (v.flat != "") & (((y1 <= page_height * 0.095) & top) | ((y0 >= page_height * 0.90) & bottom))


@staged
def numbered_narrative_list(v: View) -> Column:
    numbered = F.filter(v.rows, lambda x: matches(x, P.NUMBERED_LINE))
    n = F.size(numbered)
    brackets = v.count_rows(lambda x: matches(x, P.BRACKET_START))
    references = (brackets >= 2) & (matches(v.flat, P.YEAR) | matches(v.flat, P.VENUE))
    average = ratio(F.aggregate(numbered, F.lit(0), lambda a, x: a + words(x)), n)
    return (v.n_lines >= 3) & (n >= 2) & (v.words >= 16) & ~references & (matches(v.flat, P.LIST_LEAD_IN) | ((n >= 3) & (average >= 4)))


@staged
def narrative_prose(v: View) -> Column:
    labelled = v.first_rows(lambda x: matches(x, P.ACADEMIC_LABEL)) & (v.words >= 5)
    bullets = v.count_rows(lambda x: matches(x, P.BULLET) & (words(x) >= 6))
    return (v.n_lines > 0) & any_of(
        numbered_narrative_list(v),
        labelled,
        (v.words >= 16) & (bullets >= 1),
        (v.n_lines <= 3) & (v.words >= 10) & (v.punct >= 2) & (v.alpha >= 0.35),
        (v.words >= 26) & (v.punct >= 2) & (v.alpha >= 0.45),
        (v.n_lines <= 3) & (v.words >= 14) & (v.punct >= 1) & (v.avg_row >= 42) & (v.alpha >= 0.36),
        (v.n_lines >= 3) & (v.words >= 24) & (v.avg_row >= 40) & (v.punct >= 1),
    )


@staged
def paragraph_block(v: View) -> Column:
    ends = occurrences(v.text, ".?!;")
    return (v.n_lines > 0) & F.when(v.n_lines < 3, (ends >= 1) & (v.words >= 8)).otherwise((v.avg_line > 48) | (ends >= 2))


@staged
def algorithm_block(v: View, prose: Column | None = None) -> Column:
    prose = narrative_prose(v) if prose is None else prose
    io = v.count_lines(lambda x: matches(x, P.ALGORITHM_IO) & ((F.length(collapse(x)) <= 88) | matches(x, P.ALGORITHM_IO_COLON)))
    steps = v.count_lines(lambda x: matches(x, P.ALGORITHM_STEP))
    control = v.count_lines(lambda x: matches(x, P.ALGORITHM_CONTROL)) + v.count_lines(lambda x: matches(x, P.ALGORITHM_FOR))
    ends = v.count_lines(lambda x: matches(x, P.ALGORITHM_END))
    pseudo = v.count_lines(lambda x: (F.length(x) <= 120) & any_of(matches(x, P.ALGORITHM_IO), matches(x, P.ALGORITHM_CONTROL), matches(x, P.ALGORITHM_FOR)))
    first = F.slice(v.lines, 1, 2)
    heading, labelled = F.exists(first, lambda x: matches(x, P.ALGORITHM_HEADING)), F.exists(first, lambda x: matches(x, P.ACADEMIC_LABEL))
    numbered = v.count_lines(lambda x: matches(x, P.NUMBERED_PROSE))
    bare = (io == 0) & (ends == 0)
    exempt = any_of(
        bare & (steps >= 3) & (control <= 1) & (numbered >= 2),
        bare & labelled & ((v.words >= 24) | (steps <= 2)),
        bare & (v.words >= 34) & (v.punct >= 2) & (steps <= 2),
        (v.words >= 120) & (io <= 1) & (ends == 0),
        bare & (v.words >= 64) & (v.punct >= 6) & prose,
    )
    headed = heading & ((io >= 1) | (steps >= 1) | (control >= 1) | (pseudo >= 3) | ((v.n_lines >= 4) & (v.avg_line <= 70) & (v.punct <= 1) & ~prose))
    shaped = any_of(
        (io >= 1) & ((steps >= 1) | (control >= 1)),
        (steps >= 3) & ((control >= 2) | (ends >= 1)),
        (pseudo >= 4) & ((steps >= 2) | (io >= 1)),
    )
    return (v.n_lines > 0) & ~exempt & (headed | shaped)


@staged
def _explains(v: View) -> Column:
    """Sentences about symbols or examples, which narrow lines make look like table rows."""
    return (v.punct >= 1) & (((v.words >= 10) & matches(v.flat, P.TABLE_CONTINUATION)) | ((v.words >= 8) & v.lower.contains("example")))


@staged
def table_caption(v: View) -> Column:
    return decide(
        ((v.n_lines == 0) | ~matches(F.get(v.rows, F.lit(0)), P.TABLE_CAPTION), NO),
        otherwise=~any_of(
            (v.words >= 6) & matches(v.lower, P.TABLE_VERB),
            v.words >= 36,
            (v.n_lines >= 3) & (v.words >= 18),
            (v.punct >= 2) & (v.words >= 14),
            (v.words >= 12) & (v.punct >= 1) & (v.flat.contains(",") | matches(v.lower, P.TABLE_CONTINUATION)),
            (v.words >= 10) & (v.lower.contains(" that ") | v.lower.contains(" since ")),
        ),
    )


@staged
def table_header(v: View, prose: Column | None = None) -> Column:
    prose = narrative_prose(v) if prose is None else prose
    tokens = F.regexp_extract_all(v.lower, F.lit(r"[a-z][a-z0-9\-]{1,}"), F.lit(0))
    among = lambda terms: F.size(F.array_intersect(tokens, F.array(*map(F.lit, terms))))
    metrics, methods = among(P.METRIC_TERMS), among(P.METHOD_TERMS)
    shaped = (methods >= 1) | matches(v.text, r"[|/]| {2,}|\t") | matches(v.text, r"(?U)\d") | (v.n_lines >= 2)
    return (v.flat != "") & ~_explains(v) & ~prose & (matches(v.lower, P.TABLE_HEADER) | ((F.size(tokens) >= 3) & ((metrics >= 3) | ((metrics >= 2) & shaped))))


def _row(x: Column) -> Column:
    return matches(x, P.NUMERIC_ROW) | matches(x, P.SYMBOLIC_ROW)


def _lead(x: Column) -> Column:
    """1 for a row of at most 18 words whose first is a symbol, 2 if it has at most 14."""
    parts = F.split(x, " ")
    lead = F.trim(F.get(parts, F.lit(0)), F.lit(",;:.()[]{}"))
    symbol = matches(lead, r"(?U)[\d_'\-^/]") | (F.length(lead) <= 2) | ((F.upper(lead) == lead) & (F.lower(lead) != lead))
    n = F.size(parts)
    return F.when((n < 2) | (n > 18) | (lead == "") | ~symbol, 0).when(n <= 14, 2).otherwise(1)


@staged
def table_body(v: View, prose: Column | None = None) -> Column:
    prose = narrative_prose(v) if prose is None else prose
    ends = F.aggregate(v.lines, F.lit(0), lambda a, x: a + occurrences(x, ".?!"))
    numeric, symbolic = v.count_lines(lambda x: count(x, P.NUMBER) >= 3), v.count_lines(lambda x: matches(x, P.SYMBOL_TOKEN))
    few = ~((ends >= 1) & (v.words >= 8)) & (((numeric >= 2) & (v.n_lines >= 2)) | ((symbolic >= 2) & (v.n_lines >= 3) & (numeric >= 1)))
    leads, rows = v.count_rows(lambda x: _lead(x) >= 1), v.count_rows(lambda x: _lead(x) == 2)
    share = lambda n: n / F.greatest(v.n_lines, F.lit(1))
    ragged = (v.n_lines >= 8) & (share(v.count_lines(lambda x: F.length(x) <= 78)) >= 0.65) & (share(leads) >= 0.34) & (share(rows) >= 0.24)
    many = (ends <= F.greatest(F.lit(2), F.floor(v.n_lines / 3))) & (ragged | _flat_header(v))
    return (v.n_lines > 0) & ~_explains(v) & ~prose & (F.exists(v.rows, _row) | F.when(v.n_lines < 4, few).otherwise(many))


def _flat_header(v: View) -> Column:
    """The header test on the text as one line, whose only line it is then."""
    one = F.when(v.flat == "", F.array().cast("array<string>")).otherwise(F.array(v.flat))
    return table_header(View(v.flat, one, F.size(one), one, v.flat, v.lower, v.length, v.words, v.cjk, v.latin, v.punct, v.length.cast("double"), v.length.cast("double"), v.alpha))


@staged
def table_like(v: View, prose: Column | None = None) -> Column:
    prose = narrative_prose(v) if prose is None else prose
    rows = v.count_rows(lambda x: _row(x) | ((count(x, P.NUMBER) >= 3) & (F.length(x) <= 96)))
    grid = (v.n_lines > 0) & (rows >= 2) & (v.count_rows(lambda x: F.length(x) <= 96) / F.greatest(v.n_lines, F.lit(1)) >= 0.6)
    return (v.flat != "") & ~_explains(v) & (table_caption(v) | (~prose & (table_header(v, prose) | table_body(v, prose) | grid)))


def reference_heading(v: View) -> Column:
    return v.first_rows(lambda x: matches(x, P.REFERENCE_HEADING))


def reference_starts(v: View) -> Column:
    return v.count_rows(lambda x: matches(x, P.REFERENCE_START))


def contributions(v: View) -> Column:
    return v.lower.contains("contribution") & contains_any(v.lower, P.PROPOSAL_VERBS)


def reference_entry(v: View) -> Column:
    starts = reference_starts(v)
    year, venue, author = matches(v.flat, P.YEAR), matches(v.flat, P.VENUE), matches(v.flat, P.AUTHOR)
    leads = matches(F.get(v.rows, F.lit(0)), P.REFERENCE_START)
    vetoed = ((starts >= 1) & contributions(v)) | (matches(v.lower, P.PROPOSAL) & ~year & (starts <= 2))
    return (v.n_lines > 0) & ~vetoed & any_of(
        (starts >= 2) & (v.words <= 120) & (v.n_lines <= 12) & (venue | (year & author)),
        leads & (year | venue | author),
        year & (v.lower.contains(" doi") | v.lower.contains(" arxiv")) & ((starts >= 1) | leads),
        author & year & (venue | (starts >= 1)) & (v.n_lines <= 4) & (v.avg_line <= 120),
        (starts >= 1) & year & venue & (v.words <= 48),
    )


def title_block(v: View) -> Column:
    return all_of(
        v.flat != "", ~contains_any(v.flat, ["http://", "https://", "doi", "arxiv"]), v.n_lines.between(1, 4), v.words.between(6, 36), v.cjk <= 2, v.punct <= 2,
        ~matches(v.flat, r"[=<>\\/\[\]{}_^$]"), v.avg_line >= 18,
    )


def notation_line(c: Column) -> Column:
    x = collapse(c)
    return (x != "") & (matches(x, P.STRUCTURE_LINE) | ((F.length(x) <= 140) & matches(x, P.STRUCTURE_TOKEN)))


def continues(before: Column, after: Column) -> Column:
    """Whether a fragment goes on in the next."""
    a, b = strip(before), strip(after)
    return (a != "") & (b != "") & ~matches(b, P.LIST_ITEM) & any_of(matches(b, r"(?U)\A[\p{Ll}\d=+\-*/^_(\[{⊕←]"), matches(a, P.OPEN_END), matches(a, P.JOINER_END))


def heading_line(c: Column) -> Column:
    return (F.length(c) <= 96) & matches(c, P.HEADING_LINE)


def target_heading(c: Column) -> Column:
    """A short heading in the target language."""
    x = collapse(c)
    return (x != "") & (((F.length(x) <= 28) & matches(x, P.TARGET_HEADING)) | F.replace(x, F.lit(" ")).isin(P.TARGET_HEADINGS))


def worth_logging(v: View) -> Column:
    """Skips of longer texts that are worth a diagnostic."""
    return (v.length >= 24) & ((v.words >= 4) | (v.cjk >= 8))


def label_matches(c: Column, labels: list[str]) -> Column:
    """A layout label among these, or containing one of four characters or more."""
    x = F.lower(collapse(c))
    return x.isin(labels) | contains_any(x, [t for t in labels if len(t) >= 4])


def algorithm_heading(v: View) -> Column:
    return v.first_rows(lambda x: matches(x, P.ALGORITHM_HEADING))


def quick(c: Column, predicate) -> Column:
    """A predicate over a view straight from a column, for one-off use."""
    return predicate(view(c))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "F", "P", "View", "cjk")]
