"""Candidates of tables, as a page's table finder gives them, and which of them are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.geometry import Rect
from . import regions

PAGE = regions.PAGE


def outlier(by_text: Column, page_width: Column, page_height: Column) -> Column:
    """A candidate that can't be a table: most of a page, or, found by text alignment, too much of it for its shape."""
    r = Rect.of()
    wide, high = r.width / page_width, r.height / page_height
    area = wide * high
    rows, cols = F.col("row_count"), F.col("col_count")
    return (area >= 0.72) | (
        by_text
        & (
            ((area >= 0.38) & (wide >= 0.74) & (high >= 0.45)) | ((area >= 0.52) & (wide >= 0.88) & (high >= 0.62)) | ((rows >= 55) & (cols <= 10) & (area >= 0.45)) | ((rows >= 40) & (area >= 0.30))
            | ((rows * F.greatest(cols, F.lit(1)) >= 220) & (area >= 0.20)) | ((high >= 0.60) & (wide <= 0.40)) | ((high >= 0.48) & (wide <= 0.32) & (area >= 0.08) & (rows <= 18) & (cols <= 8))
        )
    )


def kept_in_order(candidates: DataFrame, order: list[str], threshold: float = 0.90) -> DataFrame:
    """Near copies of earlier candidates dropped, in the order of strategies."""
    item = F.struct(*order, "x0", "y0", "x1", "y1")

    def step(kept: Column, r: Column) -> Column:
        return F.when(F.forall(kept, lambda k: G.iou(Rect.field(r), Rect.field(k)) <= threshold), F.array_append(kept, r)).otherwise(kept)

    grouped = candidates.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("all"))
    return grouped.select(*PAGE, F.explode(F.aggregate("all", F.slice("all", 1, 0), step)).alias("r")).select(*PAGE, *(F.col(f"r.{n}").alias(n) for n in regions.RECT))


def found(candidates: DataFrame, blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Tables among candidates (region_id, page, rectangle, strategy, by_text, row_count, col_count). blocks as for overreaching."""
    sound = candidates.filter(~outlier(F.col("by_text"), F.lit(page_width), F.lit(page_height)))
    over = regions.overreaching(sound.filter("by_text"), blocks)
    return kept_in_order(sound.join(over, "region_id", "left_anti"), ["strategy", "region_id"])


def caption_clips(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """page, rectangle below each caption in which to look for a table: up to the first note or paragraph. In points.

    blocks: page, rectangle, block_index, and flags caption, note, paragraph, table.
    """
    c = blocks.filter("caption").select(*PAGE, F.col("block_index").alias("caption_index"), *(F.col(n).alias(f"c_{n}") for n in regions.RECT))
    own, cap = Rect.of(), Rect.of("c_")
    gap = F.col("y0") - F.col("c_y1")
    stops = c.join(blocks, PAGE).filter((gap > 2.0) & (gap <= 300.0) & (G.horizontal_overlap(cap, own) >= 0.30) & (F.col("note") | (F.col("paragraph") & ~F.col("table"))))
    cut = stops.groupBy(*PAGE, "caption_index").agg(F.min("y0").alias("stop"))
    bottom = F.least(F.lit(page_height), F.col("c_y1") + min(260.0, page_height * 0.40))
    bottom = F.least(bottom, F.greatest(F.col("c_y1") + 36.0, F.coalesce(F.col("stop") - 2.0, F.lit(page_height))))
    clip = c.join(cut, [*PAGE, "caption_index"], "left").select(
        *PAGE, "caption_index", F.greatest(F.lit(0.0), F.col("c_x0") - page_width * 0.05).alias("x0"), F.greatest(F.lit(0.0), F.col("c_y1") - 2.0).alias("y0"),
        F.least(F.lit(page_width), F.col("c_x1") + page_width * 0.05).alias("x1"), bottom.alias("y1"),
    )
    return clip.filter((own.height >= 40) & (own.width >= 80))


def found_in_clips(candidates: DataFrame, clips: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Tables among candidates (page, caption_index, rectangle) found within clips."""
    k = clips.select(*PAGE, "caption_index", F.col("y0").alias("k_y0"), F.col("y1").alias("k_y1"))
    r = Rect.of()
    sound = (r.width >= 80) & (r.height >= 28) & (F.col("y0") <= F.col("k_y1") + 6) & (F.col("y1") >= F.col("k_y0") - 6) & (r.area / (page_width * page_height) < 0.52)
    return kept_in_order(candidates.join(k, [*PAGE, "caption_index"]).filter(sound), ["caption_index"])


def first_of(page_tables: DataFrame, fallback: DataFrame) -> DataFrame:
    """A page's tables; those of the fallback only for pages that have none."""
    return regions.union_regions(page_tables, fallback.join(page_tables.select(*PAGE).distinct(), PAGE, "left_anti"))


def ranked(tables: DataFrame) -> DataFrame:
    """Tables with their number on the page, from the top."""
    return tables.withColumn("table_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "y1", "x1")))
