"""Text as Column expressions: white space, counts, normalisation, line views. Everything but NFKC stays in Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from functools import reduce, wraps

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

NEWLINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def count(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


#: White space as Unicode has it, and the four separators of ASCII; as a class of characters and one by one.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any kind (trim() takes spaces only) at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def rstrip_of(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars)) if chars else c


def collapse(c: Column) -> Column:
    """White space runs become one space; none at the ends.

    Single spaces, which most runs are, are not matched at all; a look ahead passes over ASCII's other characters quickly.
    """
    return strip(sub(c, f"(?![!-~])(?: {BLANK}+|(?! ){BLANK}+)", " "))


def words(c: Column) -> Column:
    return count(c, P.WORD)


def cjk(c: Column) -> Column:
    return count(c, P.CJK)


def occurrences(c: Column, marks: str) -> Column:
    """How many characters of c are among marks."""
    return F.length(c) - F.length(F.translate(c, marks, ""))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def contains_any(c: Column, terms: list[str]) -> Column:
    return any_of(*(c.contains(t) for t in terms))


def hits(*conditions: Column) -> Column:
    return reduce(lambda a, b: a + b, (x.cast("int") for x in conditions))


def decide(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def lines(c: Column) -> Column:
    """The stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(c, NEWLINE), strip), lambda x: x != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(P.WORD), F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b with b at least 1."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


@dataclass
class View:
    """What predicates look at, computed once for a text."""

    text: Column
    lines: Column
    n_lines: Column
    rows: Column  # lines with their white space collapsed
    flat: Column
    lower: Column
    length: Column
    words: Column
    cjk: Column
    latin: Column
    punct: Column  # . ? ! ; :
    avg_line: Column
    avg_row: Column
    alpha: Column  # share of letters in flat
    known: dict[str, Column] = field(default_factory=dict)  # results of predicates that are columns already

    def first_rows(self, condition) -> Column:
        return F.exists(F.slice(self.rows, 1, 2), condition)

    def count_rows(self, condition) -> Column:
        return F.size(F.filter(self.rows, condition))

    def count_lines(self, condition) -> Column:
        return F.size(F.filter(self.lines, condition))


def view(c: Column) -> View:
    """A view by expressions; for many predicates, with_view has it computed once."""
    text = F.coalesce(c, F.lit(""))
    own = lines(text)
    rows = F.transform(own, collapse)
    flat = collapse(text)
    mean = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x)) / F.greatest(F.size(a), F.lit(1))
    return View(
        text=text, lines=own, n_lines=F.size(own), rows=rows, flat=flat, lower=F.lower(flat), length=F.length(flat), words=words(flat), cjk=cjk(flat), latin=count(flat, P.LATIN),
        punct=occurrences(flat, ".?!;:"), avg_line=mean(own), avg_row=mean(rows), alpha=ratio(count(flat, r"\p{L}"), F.length(flat)),
    )


def with_view(df: DataFrame, column: str, prefix: str = "_v_") -> tuple[DataFrame, View]:
    """df with the view's columns, in steps so that each is computed once, and a view of those columns."""
    c = lambda n: F.col(prefix + n)
    df = df.withColumn(f"{prefix}text", F.coalesce(F.col(column), F.lit("")))
    df = df.withColumns({f"{prefix}lines": lines(c("text")), f"{prefix}flat": collapse(c("text"))})
    df = df.withColumn(f"{prefix}rows", F.transform(c("lines"), collapse))
    mean = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x)) / F.greatest(F.size(a), F.lit(1))
    flat = c("flat")
    df = df.withColumns(
        {
            f"{prefix}n_lines": F.size(c("lines")), f"{prefix}lower": F.lower(flat), f"{prefix}length": F.length(flat), f"{prefix}words": words(flat), f"{prefix}cjk": cjk(flat), f"{prefix}latin": count(flat, P.LATIN),
            f"{prefix}punct": occurrences(flat, ".?!;:"), f"{prefix}avg_line": mean(c("lines")), f"{prefix}avg_row": mean(c("rows")), f"{prefix}alpha": ratio(count(flat, r"\p{L}"), F.length(flat)),
        }
    )
    return df, View(**{f.name: c(f.name) for f in fields(View) if f.name != "known"})


def staged(predicate: Callable[..., Column]) -> Callable[..., Column]:
    """A predicate that takes its result from the view where with_known has made it a column."""

    @wraps(predicate)
    def run(v: View, *more) -> Column:
        return v.known[predicate.__name__] if predicate.__name__ in v.known else predicate(v, *more)

    return run


def with_known(df: DataFrame, v: View, *predicates: Callable[[View], Column], prefix: str = "_v_") -> tuple[DataFrame, View]:
    """df with a column for each of these, one after another, and a view by which later predicates find them."""
    for f in predicates:
        df = df.withColumn(f"{prefix}{f.__name__}", f(v))
        v = replace(v, known={**v.known, f.__name__: F.col(f"{prefix}{f.__name__}")})
    return df, v


def drop_view(df: DataFrame, prefix: str = "_v_") -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(prefix)))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no function."""
    return s.str.normalize("NFKC")


def repair_unicode(c: Column, composed: Column | None = None) -> Column:
    """Composition, look-alikes of ASCII operators, spacing after punctuation and operators, placeholder boxes."""
    x = nfkc(c) if composed is None else composed
    x = F.translate(x, "∗−′⁄⌈⌉⌊⌋Â", "*-'/[][]")
    x = sub(sub(x, "″", "''"), "‴", "'''")
    x = sub(x, r"(?<=[,;:])(?=[A-Za-z])", " ")
    x = sub(x, r"([*=/<>≤≥±×÷])(?=[A-Za-z])", "$1 ")
    return sub(sub(x, r"(?<=[A-Za-z0-9])□(?=[A-Za-z0-9'*])", "*"), "□")


def clean_extracted(c: Column, composed: Column | None = None) -> Column:
    """Extracted text without control characters, repaired, with single spaces and at most one blank line."""
    x = repair_unicode(sub(c, P.CONTROL), composed)
    return strip(sub(sub(x, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def keeps_lines(v: View) -> Column:
    """Whether the lines of a text are its structure: notation lists, pseudo code and the like."""
    markers = v.count_rows(lambda x: matches(x, P.STRUCTURE_LINE))
    tokens = count(F.array_join(v.rows, " "), P.STRUCTURE_TOKEN)
    short = ratio(v.count_rows(lambda x: F.length(x) <= 92), v.n_lines)
    return (v.n_lines >= 3) & ((markers >= 2) | ((tokens >= 3) & (short >= 0.45)))


def compact(c: Column, repaired: Column | None = None) -> Column:
    """The text that goes to a model: hyphens at line ends closed; lines kept where they are structure, else joined by semicolons.

    Joining by semicolons makes a short block of several lines look like code to the predicates; that is wanted.
    """
    x = repair_unicode(c) if repaired is None else repaired
    glued = sub(x, "-\n")
    kept = F.array_join(F.transform(lines(glued), lambda s: strip(sub(s, r"[ \t]{2,}", " "))), "\n")
    joined = sub(sub(sub(glued, r"(?U)\s*\n+\s*", " ; "), r"(?U)(?:\s*;\s*){2,}", " ; "), r"[ \t]{2,}", " ")
    return F.when(keeps_lines(view(x)), kept).otherwise(strip(joined))


def fingerprint(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def first_sentence(c: Column) -> Column:
    return strip(F.element_at(F.split(c, r"(?U)[.!?;:]\s+", 2), 1))


def strip_fence(c: Column) -> Column:
    x = strip(c)
    return F.when(x.startswith("```"), strip(sub(sub(x, r"(?U)^```(?:json)?\s*"), r"(?U)\s*```\z"))).otherwise(x)


def label(c: Column) -> Column:
    return F.lower(collapse(c))


def style(c: Column) -> Column:
    """The profile itself, or nothing for the spellings of the default."""
    key = F.translate(F.lower(strip(c)), "- ", "__")
    return F.when(key.isin(P.DEFAULT_STYLES), F.lit("")).otherwise(strip(c))


def truncated(c: Column, limit: Column) -> Column:
    """Whole sentences up to about limit characters; the first always stays. Text without an end of a sentence is cut hard."""
    x = strip(c)
    pieces = F.filter(F.transform(F.split(x, r"(?U)(?<=[。！？!?；;])\s*"), strip), lambda s: s != "")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a: Column, s: Column) -> Column:
        stop = a["done"] | ((a["n"] > 0) & (a["n"] + F.length(s) > limit))
        n = a["n"] + F.length(s)
        return F.when(stop, F.struct(a["out"].alias("out"), a["n"].alias("n"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(a["out"], s).alias("out"), n.alias("n"), (n >= limit).alias("done")))

    kept = F.aggregate(pieces, zero, step, lambda a: a["out"])
    hard = F.rtrim(F.substring(x, F.lit(1), limit), F.lit(" ,;:.-，；："))
    return F.when(F.length(x) <= limit, x).when(F.size(pieces) > 0, kept).otherwise(hard)


def item_count(c: Column) -> Column:
    """Markers of numbered items."""
    return count(c, P.ITEM_MARKER)


def item_positions(c: Column) -> Column:
    """0-based places of the markers of numbered items: a fold over what stands between them."""
    whole = F.regexp_extract_all(c, F.lit(P.ITEM_MARKER), F.lit(0))
    labels = F.regexp_extract_all(c, F.lit(P.ITEM_MARKER), F.lit(1))
    # Splitting on the markers gives the gaps; marker k starts behind gap 0..k and markers 0..k-1.
    gaps = F.split(c, P.ITEM_MARKER)
    both = F.zip_with(F.zip_with(whole, F.slice(gaps, F.lit(1), F.size(whole)), lambda w, g: F.struct(w.alias("w"), g.alias("g"))), labels, lambda x, m: F.struct(F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("whole"), F.length(m).alias("label")))
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end"))
    return F.aggregate(both, start, lambda a, m: F.struct(F.array_append(a["at"], a["end"] + m["gap"] + m["whole"] - m["label"]).alias("at"), (a["end"] + m["gap"] + m["whole"]).alias("end")), lambda a: a["at"])
