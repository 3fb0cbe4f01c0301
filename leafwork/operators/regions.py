"""Regions of a page that aren't translated, and what blocks do about them.

Joins of blocks and regions have the page as their equality key; a page's blocks and regions are few, so a page is one
group wherever a fold needs order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import predicates as is_
from ..functions.geometry import Rect
from ..functions.text import View, matches

PAGE = ["doc_id", "page_no"]
RECT = ["x0", "y0", "x1", "y1"]


def deduplicate(regions: DataFrame, threshold: float, by: list[str], strict: bool = False) -> DataFrame:
    """Greedy non-maximum suppression: in the order (y0, x0, y1, x1), a region stays if no kept one has that IoU with it."""
    item = F.struct("y0", "x0", "y1", "x1")
    passes = (lambda x: x <= threshold) if strict else (lambda x: x < threshold)

    def step(kept: Column, r: Column) -> Column:
        return F.when(F.forall(kept, lambda k: passes(G.iou(Rect.field(r), Rect.field(k)))), F.array_append(kept, r)).otherwise(kept)

    grouped = regions.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("all"))
    empty = F.slice("all", 1, 0)
    return grouped.select(*by, F.explode(F.aggregate("all", empty, step)).alias("r")).select(*by, *(F.col(f"r.{n}").alias(n) for n in RECT))


def max_coverage(blocks: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """key, coverage (greatest share of the block in one region), in_region (some overlap is significant) of every block."""
    a, b = Rect.of(), Rect.of("r_")
    r = regions.select(*PAGE, *(F.col(n).alias(f"r_{n}") for n in RECT))
    both = blocks.select(*PAGE, *[k for k in key if k not in PAGE], *RECT).join(r, PAGE, "left")
    some = F.col("r_x0").isNotNull()  # least and greatest pass over nulls
    return both.groupBy(*key).agg(F.coalesce(F.max(F.when(some, G.coverage(a, b))), F.lit(0.0)).alias("coverage"), F.coalesce(F.max(F.when(some, G.significant(a, b))), F.lit(False)).alias("in_region"))


def excluded(in_region: Column, coverage: Column, narrative: Column) -> Column:
    """In a region, a block stays if less than 52 % of it is, or 82 % of a narrative one."""
    return in_region & (coverage >= 0.52) & ~(narrative & (coverage < 0.82))


def narrative_like(v: View) -> Column:
    return is_.paragraph_block(v) | is_.narrative_prose(v) | is_.formula_narrative_fragment(v)


def rule_lines(segments: DataFrame, page_width: Column, zoom: float = G.ZOOM) -> DataFrame:
    """Straight segments (x0, y0, x1, y1) that are level and wide enough: left, y, right. One pixel space for all of it."""
    level = (F.abs(F.col("y1") - F.col("y0")) <= 1.1 * zoom) & (F.abs(F.col("x1") - F.col("x0")) >= F.greatest(F.lit(50.0 * zoom), page_width * 0.24))
    return segments.filter(level).select(*PAGE, F.least("x0", "x1").alias("left"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.greatest("x0", "x1").alias("right"))


def rule_bands(lines: DataFrame, page_width: float, zoom: float = G.ZOOM) -> DataFrame:
    """Bands between a rule and the first fitting rule below it.

    Rules at about one height are merged by a fold; pairs come from a join on the page, and the first by a window.
    """
    item = F.struct("y", "left", "right")

    def merge(kept: Column, r: Column) -> Column:
        last = F.element_at(kept, -1)
        share = F.greatest(F.lit(0.0), F.least(r["right"], last["right"]) - F.greatest(r["left"], last["left"])) / F.greatest(F.lit(1.0), F.least(r["right"] - r["left"], last["right"] - last["left"]))
        joined = F.struct(((r["y"] + last["y"]) / 2).alias("y"), F.least(r["left"], last["left"]).alias("left"), F.greatest(r["right"], last["right"]).alias("right"))
        same = (F.abs(r["y"] - last["y"]) <= 2.0 * zoom) & (share >= 0.7)
        return F.when(F.size(kept) == 0, F.array(r)).when(same, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), joined)).otherwise(F.array_append(kept, r))

    merged = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("all"))
    rules = merged.select(*PAGE, F.posexplode(F.aggregate("all", F.slice("all", 1, 0), merge)).alias("k", "r")).select(*PAGE, "k", "r.*")
    low, high, wide = G.scaled(38.0, zoom, 18.0), G.scaled(980.0, zoom, 220.0), max(90.0, page_width * 0.20)
    below = rules.select(*PAGE, F.col("k").alias("k2"), F.col("y").alias("y2"), F.col("left").alias("left2"), F.col("right").alias("right2"))
    shared = F.least("right", "right2") - F.greatest("left", "left2")
    fits = (F.col("k2") > F.col("k")) & (F.col("y2") - F.col("y")).between(low, high) & (shared >= wide) & (shared / F.greatest(F.lit(1.0), F.least(F.col("right") - F.col("left"), F.col("right2") - F.col("left2"))) >= 0.72)
    first = Window.partitionBy(*PAGE, "k").orderBy("k2")
    bands = rules.join(below, PAGE).filter(fits).withColumn("n", F.row_number().over(first)).filter("n = 1")
    margin = 2.5 * zoom
    out = bands.select(*PAGE, (F.greatest("left", "left2") - margin).alias("x0"), (F.col("y") - margin).alias("y0"), (F.least("right", "right2") + margin).alias("x1"), (F.col("y2") + margin).alias("y1"))
    return deduplicate(out, 0.92, PAGE, strict=True)


def algorithm_regions(bands: DataFrame, headings: DataFrame, pad: float = 2.0) -> DataFrame:
    """Bands with an algorithm heading in their upper 34 %."""
    h = headings.select(*PAGE, *(F.col(n).alias(f"h_{n}") for n in RECT))
    head = Rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0") + (F.col("y1") - F.col("y0")) * 0.34)
    found = bands.join(h, PAGE).filter(G.touches(head, Rect.of("h_"))).select(*PAGE, *RECT).distinct()
    return found.select(*PAGE, *((F.col(n) - pad).alias(n) for n in ("x0", "y0")), *((F.col(n) + pad).alias(n) for n in ("x1", "y1")))


_GROWN = "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double"


def caption_regions(blocks: DataFrame, zoom: float = G.ZOOM) -> DataFrame:
    """Tables grown downwards from their captions.

    blocks: page, rectangle, block_index, and flags caption, note, paragraph, body of each. The walk down a page is
    stateful, so a page is an array, and those with a caption go to Python; text predicates are computed before, in Catalyst.
    """
    tallest, most = max(96.0, 180.0 * zoom / G.BASE_ZOOM), G.scaled(460.0, zoom, 180.0)

    def grow(rows: list[dict]) -> Iterator[tuple[float, float, float, float]]:
        for k, c in enumerate(rows):
            if not c["caption"] or c["y1"] - c["y0"] > tallest:
                continue
            box, last, grown = [c["x0"], c["x1"], c["y1"]], c["y1"], False
            for b in rows[k + 1 :]:
                if b["y0"] <= c["y0"]:
                    continue
                if b["y1"] - c["y0"] > most or b["y0"] - last > 72:
                    break
                share = max(0.0, min(c["x1"], b["x1"]) - max(c["x0"], b["x0"])) / max(1.0, min(c["x1"] - c["x0"], b["x1"] - b["x0"]))
                if share < 0.35:
                    continue
                if b["note"] or b["paragraph"]:
                    break
                if b["body"]:
                    box, last, grown = [min(box[0], b["x0"]), max(box[1], b["x1"]), max(box[2], b["y1"])], b["y1"], True
            x0, x1, y1 = box if grown else (c["x0"], c["x1"], c["y1"])
            yield x0 - 2.0, c["y0"] - 2.0, x1 + 2.0, y1 + 2.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = zip(*(b.column(n).to_pylist() for n in (*PAGE, "rows")))
            out = [(*page, *r) for *page, rows in pages for r in grow(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, (pa.int64(), pa.int32(), *[pa.float64()] * 4))], names=[*PAGE, *RECT])

    sides = (F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))).alias(n) for n in RECT)
    item = F.struct("block_index", *sides, "caption", "note", "paragraph", "body")
    pages = blocks.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    return pages.filter(F.exists("rows", lambda b: b["caption"])).mapInArrow(run, _GROWN)


def table_note(v: View) -> Column:
    return matches(v.text, P.TABLE_NOTE)


def overreaching(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """The candidates of a table (key region_id) that swallow prose: one long paragraph nearly whole, or two.

    blocks: rectangle, paragraph, table (looks like a table's text), words, punct.
    """
    b = blocks.filter(F.col("paragraph") & ~F.col("table") & (F.col("words") >= 8)).select(*PAGE, *(F.col(n).alias(f"b_{n}") for n in RECT), "words", "punct")
    own, block = Rect.of(), Rect.of("b_")
    of_block, of_own = G.coverage(block, own), G.coverage(own, block)
    hit = candidates.join(b, PAGE).filter((G.overlap(own, block)[2] > 0) & ((of_block >= 0.40) | (of_own >= 0.08)))
    whole = (of_block >= 0.78) & (F.col("words") >= 42) & (F.col("punct") >= 2)
    return hit.groupBy("region_id").agg(F.bool_or(whole).alias("whole"), F.count(F.lit(1)).alias("n")).filter("whole or n >= 2").select("region_id")


def trimmed_tables(tables: DataFrame, blocks: DataFrame, page_area: float, pad: float = 1.0, zoom: float = G.ZOOM) -> DataFrame:
    """Table regions (key region_id): large ones that swallow prose go, others end above a note or paragraph within 80 points below."""
    over = overreaching(tables.filter(Rect.of().area >= page_area * 0.14), blocks)
    stay = tables.join(over, "region_id", "left_anti")
    stops = blocks.filter("note or paragraph").select(*PAGE, *(F.col(n).alias(f"b_{n}") for n in RECT))
    below = (F.col("b_y0") >= F.col("y1")) & (F.col("b_y0") < F.col("y1") + 80 * zoom) & (F.col("b_x0") < F.col("x1")) & (F.col("b_x1") > F.col("x0"))
    cut = stay.join(stops, PAGE).filter(below).groupBy("region_id").agg(F.min("b_y0").alias("stop"))
    foot = F.least("y1", F.coalesce(F.col("stop") - 1.0, "y1"))
    return stay.join(cut, "region_id", "left").select("region_id", *PAGE, (F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"), (F.col("x1") + pad).alias("x1"), (foot + pad).alias("y1"))


def union_regions(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*PAGE, *RECT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*PAGE, *RECT))
    return out


def layout_hints(nodes: DataFrame) -> DataFrame:
    """page, kind (table, reference, skip), rectangle from detected nodes (label, rectangle), near copies of each kind dropped."""
    kind = F.when(is_.label_matches(F.col("label"), P.TABLE_LABELS), "table").when(is_.label_matches(F.col("label"), P.REFERENCE_LABELS), "reference").when(is_.label_matches(F.col("label"), P.SKIP_LABELS), "skip")
    known = nodes.withColumn("kind", kind).filter("kind is not null")
    both = deduplicate(known.filter("kind <> 'skip'"), 0.88, [*PAGE, "kind"])
    return both.unionByName(deduplicate(known.filter("kind = 'skip'"), 0.90, [*PAGE, "kind"]))


# References -----------------------------------------------------------------------------------------------------------


def layout_reference_start(regions: DataFrame, page_height: float) -> DataFrame:
    """page, start_y: the highest reference region that is high enough, unless it starts below 92 % of the page."""
    found = regions.filter(F.col("y1") - F.col("y0") >= 12.0).groupBy(*PAGE).agg(F.min("y0").alias("start_y"))
    return found.filter(F.col("start_y") <= page_height * 0.92)


def reference_anchor(blocks: DataFrame) -> DataFrame:
    """doc_id, anchor_page, anchor_y: the first reference heading of a document. blocks: flag heading."""
    first = F.min(F.struct("page_no", "block_index", "y0"))
    return blocks.filter("heading").groupBy("doc_id").agg(first.alias("a")).select("doc_id", F.col("a.page_no").alias("anchor_page"), F.col("a.y0").alias("anchor_y"))


def references_start(blocks: DataFrame) -> DataFrame:
    """page, start_y: where references start on a page, by a heading, else by entries among the blocks from there on.

    blocks: block_index, y0, y1, and flags heading, entry (an entry, or a line that starts like one), contributions (a list
    of the paper's own contributions). A page with such a list has no references unless it has a heading.
    """
    down = Window.partitionBy(*PAGE).orderBy("y0", "block_index")
    rest = down.rowsBetween(0, Window.unboundedFollowing)
    page = Window.partitionBy(*PAGE)
    counted = blocks.withColumns(
        {
            "entries": F.sum(F.col("entry").cast("int")).over(rest), "n": F.count(F.lit(1)).over(rest), "bottom": F.max("y1").over(page),
            "heading_at": F.min(F.when(F.col("heading"), F.col("block_index"))).over(page), "listed": F.max(F.col("contributions")).over(page),
        }
    )
    share = F.col("entries") / F.col("n")
    enough = (F.col("entries") >= 6) | ((F.col("y0") >= F.col("bottom") * 0.32) & (F.col("entries") >= 3) & (share >= 0.42)) | ((F.col("entries") >= 4) & (share >= 0.6))
    by_entry = F.min(F.when(F.col("entry") & enough & ~F.col("listed"), F.col("y0")))
    by_heading = F.min(F.when(F.col("block_index") == F.col("heading_at"), F.col("y0")))
    return counted.groupBy(*PAGE).agg(F.coalesce(by_heading, by_entry).alias("start_y")).filter("start_y is not null")


def reference_pages(blocks: DataFrame) -> DataFrame:
    """Pages of references: a heading, two entry blocks, the first of them not in the upper 22 %. blocks: flags heading, is_entry."""
    entry = F.col("is_entry") & ~F.col("heading")
    first = F.min_by("y0", F.when(entry, F.col("block_index")))
    found = blocks.groupBy(*PAGE).agg(F.bool_or("heading").alias("h"), F.count_if(entry).alias("n"), F.max("y1").alias("bottom"), first.alias("y"))
    return found.filter((F.col("h")) & (F.col("n") >= 2) & ~((F.col("bottom") > 0) & (F.col("y") / F.col("bottom") < 0.22))).select(*PAGE)


def reference_decision(pages: DataFrame, anchors: DataFrame, starts: DataFrame, reference_page: DataFrame, page_height: float) -> DataFrame:
    """page, reference_mode, start_y. A whole page is references if the mode is on and start_y is null or 1 at most.

    In a document with an anchor, pages after it are references, and its own from the anchor down; before it, a start in the
    lower 60 % of a page turns the mode off. Without an anchor, what the page shows stands.
    """
    mode = reference_page.withColumn("by_page", F.lit(True))
    all_ = pages.select(*PAGE).join(anchors, "doc_id", "left").join(starts, PAGE, "left").join(mode, PAGE, "left")
    after, at = F.col("page_no") > F.col("anchor_page"), F.col("page_no") == F.col("anchor_page")
    late = F.col("anchor_page").isNotNull() & F.coalesce(F.col("start_y") > page_height * 0.40, F.lit(False))
    return all_.select(
        *PAGE,
        F.when(after | at, True).when(late, False).otherwise(F.coalesce("by_page", F.lit(False))).alias("reference_mode"),
        F.when(after, F.lit(0.0)).when(at, F.col("anchor_y")).otherwise(F.col("start_y")).alias("start_y"),
    )


def heading_column(block: Rect, headings: Column, page_width: Column) -> Column:
    """Whether a block stands in the column of a heading (array of rectangles): always if there is none or it is wide."""

    def near(h: Column) -> Column:
        r = Rect.field(h)
        wide = F.greatest(F.lit(1.0), r.width) >= F.greatest(F.lit(120.0), page_width * 0.58)
        same = (G.half(block, page_width) == G.half(r, page_width)) & (F.abs(block.middle - r.middle) <= page_width * 0.34)
        return wide | (G.horizontal_overlap(block, r) >= 0.28) | same

    return (F.size(headings) == 0) | F.exists(headings, near)


def grobid_regions(coords: DataFrame, zoom: float = G.ZOOM) -> DataFrame:
    """doc_id, page_no, rectangle from strings ``page,x,y,w,h;...`` in PDF points; malformed or empty parts are dropped."""
    part = F.transform(F.split("part", ","), lambda x: x.try_cast("double"))
    rows = coords.select("doc_id", F.explode(F.split("coords", ";")).alias("part")).withColumn("v", part).filter(F.size("v") >= 5)
    v = lambda k: F.col("v")[k]
    page = v(0).cast("int")
    sound = rows.filter((page >= 1) & (v(3) > 0) & (v(4) > 0) & v(1).isNotNull() & v(2).isNotNull())
    found = sound.select("doc_id", page.alias("page_no"), (v(1) * zoom).alias("x0"), (v(2) * zoom).alias("y0"), ((v(1) + v(3)) * zoom).alias("x1"), ((v(2) + v(4)) * zoom).alias("y1"))
    return deduplicate(found, 0.90, PAGE)


__all__ = [n for n in dir() if not n.startswith("_")]
