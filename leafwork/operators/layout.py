"""Fitting translated text into the boxes of its blocks.

There is no imaging library here, so widths come from a model: a CJK character or symbol is one em wide, any other half an em.
That approximates a font; another model can be passed. Drawing is left to an adapter that reads the fitted lines.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import patterns as P
from ..functions import plain_predicates as plain
from ..functions.plain import cjk as count_cjk
from ..functions.text import collapse, keeps_lines, lines, matches, repair_unicode, strip, sub, view
from . import grouping

WidthModel = Callable[[str, float], float]


@lru_cache(1 << 16)
def _em(c: str) -> float:
    return 1.0 if unicodedata.east_asian_width(c) in "WF" else 0.5


def em_width(text: str, size: float) -> float:
    return size * sum(map(_em, text))


def folded(text: str) -> str:
    """Mathematical letters, and super- and subscripts, as plain characters."""
    return text if text.isascii() else "".join(map(_plain, text))


@lru_cache(1 << 16)
def _plain(c: str) -> str:
    kind = unicodedata.decomposition(c).partition(" ")[0]
    plain = "\U0001d400" <= c <= "\U0001d7ff" or "⁰" <= c <= "₟" or kind in ("<font>", "<super>", "<sub>")
    return (unicodedata.normalize("NFKC", c) or c) if plain else c


def wrap(text: str, size: float, width: float, model: WidthModel = em_width, most: float = math.inf) -> list[str]:
    """Character-wise lines that aren't wider than width; a line has one character at least. Beyond ``most`` lines it stops."""
    out, widths = [], {c: model(c, size) for c in set(text)}
    least = min((w for w in widths.values() if w > 0), default=0.0)
    for line in text.splitlines() or [text]:
        wide, start, n = list(map(widths.__getitem__, line)), 0, len(line)
        # So many characters fill a line, unless some have no width.
        most_chars = int(width / least) + 2 if least > 0 and min(wide, default=0.0) > 0 else n
        while start < n:
            end = start + max(1, bisect_right(list(accumulate(wide[start : start + most_chars])), width))
            out.append(line[start:end])
            if len(out) > most:
                return out
            start = end
    return out or [text]


@lru_cache(8)
def _measured(text: str) -> tuple[str, float, float]:
    """The text as it is set, its width and that of its widest character, in ems."""
    own = folded(text)
    return own, sum(map(_em, own.replace("\n", ""))), max(map(_em, own), default=0.0)


@dataclass(frozen=True)
class Tier:
    """How far text may shrink, and how tight its lines are."""

    scale: float
    least: float
    spacing: float
    factor: float = 1.0


# Fixed values.
TIERS = [Tier(0.92, 8.0, 1.1), Tier(0.55, 8.8, 1.02), Tier(0.45, 8.4, 1.0)]
CLIPPED, TIGHTER, RESCUE = Tier(0.52, 8.8, 1.0), Tier(0.38, 7.8, 0.98, 0.98), Tier(0.26, 7.0, 0.95, 0.98)
SHRINK = 0.8


@dataclass(frozen=True)
class Fit:
    lines: list[str]
    font: float
    line_height: float

    @property
    def height(self) -> float:
        return self.line_height * len(self.lines)


def fit(text: str, width: float, height: float, font: float, tier: Tier, model: WidthModel = em_width) -> Fit | None:
    """The greatest size, in steps of 0.8 from ``font`` down, at which the wrapped text is low enough."""
    (text, ems, widest), size = _measured(text), font
    while size >= max(tier.least, font * tier.scale):
        # Wrapping stops at a number of lines that is too high for certain; whether a number fits is decided by their height.
        most = max(0.0, height * tier.factor / (size * tier.spacing)) + 1
        if model is em_width and size * widest <= width and size * ems > int(height * tier.factor / (size * tier.spacing) + 1e-6) * width * (1 + 1e-6):
            # As many lines as fit, each of them full, don't hold the text: nothing is wrapped.
            size -= SHRINK
            continue
        found = Fit(wrap(text, size, width, model, most), size, size * tier.spacing)
        if found.height <= height * tier.factor:
            return found
        size -= SHRINK
    return None


def start_y(top: float, inner: float, total: float, n: int) -> float:
    left = max(0.0, inner - total)
    return top + (left * 0.18 if n <= 1 else left * 0.12 if n == 2 else min(2.0, left * 0.04))


def placed(b: dict, text: str, clipped: str, model: WidthModel = em_width) -> tuple[str, Fit | None, float]:
    """(status, fit, y of the first line) of a block: rendered, or why its original is kept.

    b: x0, y0, x1, y1, base_font_size, and short (a short source line, for which very small type is allowed).
    """
    w, h, base = max(1.0, b["x1"] - b["x0"]), max(1.0, b["y1"] - b["y0"]), b["base_font_size"]
    pad_x, pad_y = min(8.0, max(2.0, w * 0.012)), min(6.0, max(1.5, h * 0.02))
    inner_w, inner_h = max(1.0, w - 2 * pad_x), max(1.0, h - 2 * pad_y)
    found = next((f for t in TIERS if (f := fit(text, inner_w, inner_h, base, t, model))), None)
    if found is None:
        return "text_overflow_after_wrap", None, 0.0
    readable = max(8.8, min(10.9, base * 0.55))
    if h <= 72.0 and w >= 240.0:
        readable = max(readable, 9.4)
    if found.font < readable and clipped and clipped != text:
        found = fit(clipped, inner_w, inner_h, max(8.8, base * 0.92), CLIPPED, model) or found
    if found.font < readable:
        return "font_too_small_keep_original", None, 0.0
    if len(found.lines) >= 3 and found.height < inner_h * 0.72 and (stretch := min(1.28, inner_h * 0.9 / max(found.height, 1.0))) > 1.03:
        found = Fit(found.lines, found.font, found.line_height * stretch)
    fits = lambda f: (y := start_y(b["y0"] + pad_y, inner_h, f.height, len(f.lines))) + f.height <= b["y1"] - pad_y + 0.11 and (y,)
    if not (at := fits(found)):
        tighter = fit(text, inner_w, inner_h, max(8.0, found.font - 0.9), TIGHTER, model)
        if tighter is None or tighter.font < max(7.8, readable - 0.6) or not (at := fits(tighter)):
            last = found.font if tighter is None else tighter.font
            tighter = fit(text, inner_w, inner_h, max(7.8, min(last * 0.88, base * 0.46)), RESCUE, model) if b["short"] else None
            if tighter is None or not (at := fits(tighter)):
                return "layout_clipped_keep_original", None, 0.0
        found = tighter
    return "rendered", found, at[0]


def render_text(source: Column, target: Column) -> Column:
    """The translation as it is set: lines kept where the source's are structure, else one line."""
    x = strip(repair_unicode(strip(target)))
    own = F.transform(lines(x), lambda s: sub(strip(sub(s, r"[ \t]{2,}", " ")), r"(?U)^['`‘’]+\s*"))
    kept = F.array_join(F.filter(own, lambda s: ~matches(collapse(s), P.CONTINUATION_MARKER)), "\n")
    flat = strip(sub(sub(x, r"(?U)\s*\n+\s*", " "), r"[ \t]{2,}", " "))
    return F.when(keeps_lines(view(source)), kept).otherwise(flat)


_FITTED = "doc_id long, page_no int, block_index int, status string, font double, line_height double, y double, lines array<string>"


def render(blocks: DataFrame, model: WidthModel = em_width) -> DataFrame:
    """doc_id, page_no, block_index, status, font, line_height, y, lines. blocks: rectangle, base_font_size, text (or facts of it), translation."""
    given = "facts" in blocks.columns
    sides = ["x0", "y0", "x1", "y1", "base_font_size"]
    ready = blocks.filter("translation is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), F.col("block_index").cast("int").alias("block_index"),
        *(F.col(n).cast("double").alias(n) for n in sides), "facts" if given else "text", "translation",
    )
    schema = to_arrow_schema(T._parse_datatype_string(_FITTED))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for *key, x0, y0, x1, y1, font, source, target in zip(*(c.to_pylist() for c in batch.columns)):
                keeps, n, en, n_items, marks = source.values() if given else plain.facts(source)
                text = plain.set_text(target, keeps)
                if not text:
                    continue
                low, wide = y1 - y0 <= 34.0, x1 - x0 >= 120.0
                short = low and wide and 2 <= en <= 7 and n <= 64 and marks <= 1 and len(flat := " ".join(text.split())) <= 24 and count_cjk(flat) <= 12
                b = {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "base_font_size": font, "short": short}
                status, f, y = placed(b, text, plain.tight_box(n, en, n_items, text, y1 - y0, x1 - x0), model)
                yield *key, status, *((f.font, f.line_height, y, f.lines) if f else (None,) * 4)

    return ready.mapInArrow(lambda batches: grouping.in_batches(fitted(batches), schema), _FITTED)


def diagnostics(rendered: DataFrame, blocks: DataFrame) -> DataFrame:
    """page, kind (layout_overflow, untranslated_blocks), bbox, source_excerpt, reason of blocks that keep their original."""
    bad = rendered.filter("status <> 'rendered'").join(blocks, ["doc_id", "page_no", "block_index"])
    bbox = F.array("x0", "y0", "x1", "y1")
    twin = F.when(F.col("status") == "text_overflow_after_wrap", "overflow_keep_original").otherwise(F.col("status"))
    kinds = F.array(F.struct(F.lit("layout_overflow").alias("kind"), F.col("status").alias("reason")), F.struct(F.lit("untranslated_blocks").alias("kind"), twin.alias("reason")))
    return bad.select("doc_id", "page_no", bbox.alias("bbox"), F.substring("text", 1, 160).alias("source_excerpt"), F.explode(kinds).alias("k")).select("doc_id", "page_no", "k.kind", "bbox", F.when(F.col("k.kind") == "untranslated_blocks", F.col("source_excerpt")).alias("source_excerpt"), "k.reason")
