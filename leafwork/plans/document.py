"""The dataflow of documents: blocks, flags, regions, admission, merging, translation, fitting, diagnostics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import predicates as is_
from ..functions.geometry import Rect
from ..functions.plain_predicates import FLAGS, flags
from ..functions.text import View, compact, decide, drop_view, view, with_known, with_view
from ..operators import grouping, layout, regions, translate
from ..sources.blocks import PAGE_HEIGHT, PAGE_WIDTH

PAGE = ["doc_id", "page_no"]
BLOCK = [*PAGE, "block_index"]

#: Why a block is not translated, in the order of the tests; the cheap ones come first.
REASONS = [
    "running_header_footer", "in_non_translatable_region", "reference_page_mode", "below_references_anchor", "ieee_license_watermark", "algorithm_block_text", "table_like_text",
    "should_translate_false", "reference_entry",
]


def flagged(blocks: DataFrame, text: bool = True) -> DataFrame:
    """Blocks with the flags of their text: what later steps, joins and windows look at. Without ``text``, it is dropped.

    Plain functions in Arrow batches; flagged_by_columns has the same flags as Column expressions.
    """
    names = [c for c in blocks.columns if text or c != "text"]
    types = [pa.int32() if n in ("words", "punct") else pa.bool_() for n in FLAGS]
    schema = T.StructType([*blocks.select(names).schema, *(T.StructField(n, T.IntegerType() if n in ("words", "punct") else T.BooleanType()) for n in FLAGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in ("text", "y0", "y1")))
            found = [flags(s, math.nan if y0 is None else y0, math.nan if y1 is None else y1, PAGE_HEIGHT) for s, y0, y1 in rows]
            columns = zip(*found) if found else [()] * len(FLAGS)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*names, *FLAGS])

    return blocks.mapInArrow(run, schema)


def flagged_by_columns(blocks: DataFrame) -> DataFrame:
    """flagged by Column expressions alone. Many times slower: the measure of the plain functions."""
    df, v = with_view(blocks, "text")
    df, v = with_known(df, v, is_.narrative_prose, is_._explains, is_.table_caption, is_.table_header, is_.table_body)
    df = df.withColumns({"prose": is_.narrative_prose(v), "heading": is_.reference_heading(v), "is_entry": is_.reference_entry(v), "starts": is_.reference_starts(v) > 0, "paragraph": is_.paragraph_block(v)})
    df = df.withColumns(
        {
            "words": v.words, "punct": v.punct, "fragment": is_.formula_narrative_fragment(v), "watermark": is_.licence_watermark(v), "algorithm": is_.algorithm_block(v, F.col("prose")),
            "algorithm_heading": is_.algorithm_heading(v), "table_like": is_.table_like(v, F.col("prose")), "caption": is_.table_caption(v), "note": regions.table_note(v),
            "body": is_.table_body(v, F.col("prose")) | is_.table_header(v, F.col("prose")), "contributions": F.col("starts") & is_.contributions(v),
            "running": is_.running_header_footer(v, F.col("y0"), F.col("y1"), F.lit(PAGE_HEIGHT)),
        }
    )
    df = df.withColumns({"entry": F.col("is_entry") | F.col("starts"), "table": F.col("caption") | F.col("body"), "narrative": F.col("paragraph") | F.col("prose") | F.col("fragment")})
    df, c = with_view(drop_view(df).withColumn("compact", compact(F.col("text"))), "compact", "_c_")
    df, c = with_known(df, c, is_.line_facts, is_.formula_narrative, is_.skipped, prefix="_c_")
    return drop_view(df.withColumn("wanted", is_.translatable(c)), "_c_").drop("compact")


def skip_reason(heading_boxes: Column) -> Column:
    """The first reason that holds, or null: over flags, coverage, in_region, reference_mode, start_y."""
    start, mode = F.col("start_y"), F.coalesce("reference_mode", F.lit(False))
    below = start.isNotNull() & (F.col("y0") >= start - 1.0) & regions.heading_column(Rect.of(), heading_boxes, F.lit(PAGE_WIDTH))
    tests = [
        F.col("running"), regions.excluded(F.col("in_region"), F.col("coverage"), F.col("narrative")), mode & (start.isNull() | (start <= 1.0)), below,
        F.col("watermark"), F.col("algorithm"), F.col("table_like"), ~F.col("wanted"), F.col("is_entry"),
    ]
    return decide(*zip(tests, REASONS))


def admission(flags: DataFrame, excluded: DataFrame) -> DataFrame:
    """flags with coverage, in_region and skip_reason (null: admitted). excluded: page and rectangle of regions.

    The joins' key is the page. What is known of documents and pages comes from aggregates with a row for each.
    """
    cover = regions.max_coverage(flags, excluded, BLOCK)
    anchors = regions.reference_anchor(flags)
    decision = regions.reference_decision(flags.select(*PAGE).distinct(), anchors, regions.references_start(flags), regions.reference_pages(flags), PAGE_HEIGHT)
    boxes = flags.filter("heading").groupBy(*PAGE).agg(F.collect_list(Rect.of().struct()).alias("boxes"))
    none = F.slice(F.array(Rect(*(F.lit(0.0) for _ in range(4))).struct()), 1, 0)
    both = flags.join(cover, BLOCK).join(decision, PAGE, "left").join(boxes, PAGE, "left")
    return both.withColumn("skip_reason", skip_reason(F.coalesce("boxes", none))).drop("boxes")


def jobs(admitted: DataFrame, zoom: float = G.ZOOM) -> DataFrame:
    """Admitted blocks with width, height and base_font_size, without their texts."""
    size = F.greatest(F.col("font_size") * zoom, F.lit(10.0))
    one = F.lit(1.0)
    out = admitted.filter("skip_reason is null").withColumns({"width": F.greatest(one, F.col("x1") - F.col("x0")), "height": F.greatest(one, F.col("y1") - F.col("y0")), "base_font_size": size})
    return out.select(*BLOCK, "x0", "y0", "x1", "y1", "width", "height", "base_font_size")


def non_translatable(flags: DataFrame, *more: DataFrame) -> DataFrame:
    """Regions of tables below captions, and any others, near copies dropped."""
    grown = regions.caption_regions(flags.select(*BLOCK, "x0", "y0", "x1", "y1", "caption", "note", "paragraph", "body"))
    return regions.deduplicate(regions.union_regions(grown, *more), 0.90, PAGE)


def translated(blocks: DataFrame, excluded: DataFrame, memory: DataFrame, providers: list, options: translate.Options, store) -> dict[str, DataFrame]:
    """The dataflow up to the translations. store(df, name) writes a table and reads it back; it cuts lineage around the provider.

    Flags are stored and joined without texts, which go through a shuffle to their pages twice: when they are merged and when
    they are translated. blocks is read for both flags and texts, so it must give the same rows each time.
    """
    marked = store(flagged(blocks, text=False), "flags")
    admitted = admission(marked, non_translatable(marked, excluded))
    merged = store(grouping.merged_pages(jobs(admitted), blocks.select(*BLOCK, "text"), PAGE_WIDTH), "jobs")
    return {**translate.translate(merged, memory, providers, options, store), "admission": admitted.select(*BLOCK, "skip_reason"), "jobs": merged}


def run(blocks: DataFrame, excluded: DataFrame, memory: DataFrame, providers: list, options: translate.Options, store) -> dict[str, DataFrame]:
    """The whole dataflow: what is translated, fitted into its boxes, and diagnostics."""
    out = translated(blocks, excluded, memory, providers, options, store)
    boxes = out["jobs"].drop("text", "prompt")
    fitted = store(layout.render(boxes.join(out["translations"].select(*BLOCK, "translation"), BLOCK)), "fitted")
    return {**out, "fitted": fitted, "diagnostics": layout.diagnostics(fitted, out["jobs"])}


__all__ = ["BLOCK", "PAGE", "REASONS", "Column", "View", "admission", "flagged", "flagged_by_columns", "jobs", "non_translatable", "run", "skip_reason", "translated", "view"]
