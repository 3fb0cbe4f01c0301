"""Results of outside services as tables: layout recognition (JSON lines), OCR, bibliographies (TEI); and the export manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import strip

_LAYOUT = "result struct<layoutParsingResults:array<struct<markdown:struct<text:string>>>>"


def markdown_from_jsonl(c: Column) -> Column:
    """The markdown of all results of a JSON-lines reply, joined by blank lines; lines that don't parse are skipped."""
    parsed = F.transform(F.filter(F.split(c, "\n"), lambda x: strip(x) != ""), lambda x: F.from_json(x, _LAYOUT))
    texts = F.flatten(F.transform(parsed, lambda p: F.coalesce(F.transform(p["result"]["layoutParsingResults"], lambda r: strip(r["markdown"]["text"])), F.array().cast("array<string>"))))
    return F.array_join(F.filter(texts, lambda x: x.isNotNull() & (x != "")), "\n\n")


def ocr_lines(results: DataFrame, key: list[str]) -> DataFrame:
    """key, text, x0..y1 (whole pixels) from rec_texts and rec_polys (arrays of points); texts without a polygon are skipped."""
    both = results.select(*key, F.posexplode("rec_texts").alias("_k", "text"), F.col("rec_polys").alias("_polys"))
    poly = F.get("_polys", F.col("_k"))
    box = G.bounds(poly)
    return both.withColumn("_b", box).filter("_b is not null").select(*key, "text", *(F.col(f"_b.{n}").cast("int").alias(n) for n in ("x0", "y0", "x1", "y1")))


def layout_rects(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """nodes (label, and arrays coordinate, bbox, box, rect; polygon, points of points) with the first usable rectangle, on the image."""
    on = lambda r: G.clamped(r, F.lit(width), F.lit(height))
    boxes = [on(G.coerced(F.col(n))) for n in ("coordinate", "bbox", "box", "rect") if n in nodes.columns]
    shapes = [on(G.bounds(F.col(n))) for n in ("polygon", "points") if n in nodes.columns]
    found = nodes.withColumn("_r", F.coalesce(*boxes, *shapes)).filter("_r is not null")
    return found.select(*[c for c in nodes.columns if c not in ("coordinate", "bbox", "box", "rect", "polygon", "points")], "_r.*")


def tei_coordinates(documents: DataFrame, xml: str = "tei") -> DataFrame:
    """doc_id, coords of every bibliographic entry of a TEI document."""
    plain = F.regexp_replace(F.col(xml), r'\sxmlns(:\w+)?="[^"]*"', "")
    return documents.select("doc_id", F.explode(F.xpath(plain, F.lit("//biblStruct/@coords"))).alias("coords"))


def export_manifest(pages: DataFrame, originals: DataFrame, translations: DataFrame) -> DataFrame:
    """session_id, page_no, image, translated: a page's translated image, else its original; pages with neither are skipped."""
    key = ["session_id", "page_no"]
    both = pages.select(*key).join(originals.select(*key, F.col("path").alias("original")), key, "left").join(translations.select(*key, F.col("path").alias("translated_path")), key, "left")
    return both.select(*key, F.coalesce("translated_path", "original").alias("image"), F.col("translated_path").isNotNull().alias("translated")).filter("image is not null")


def export_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("translated").alias("n_translated"))


def page_image(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """session_id, page_no, code for a request of a translated page: 200, 202 while it is pending, 404 outside the session. pages: requested page_no, page_count."""
    key = ["session_id", "page_no"]
    done = manifest.filter("translated").select(*key, F.lit(True).alias("_done"))
    inside = F.col("page_no").between(1, F.col("page_count"))
    return pages.join(done, key, "left").select(*key, F.when(~inside, 404).when(F.coalesce("_done", F.lit(False)), 200).otherwise(202).alias("code"))
