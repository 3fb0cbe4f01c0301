"""Where blocks come from: tables of positioned text, documents' lines, extracted spans; PDF files through an optional library."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.text import clean_extracted, strip

#: A page of 8.5 x 11 inches at 160 DPI.
PAGE_WIDTH, PAGE_HEIGHT = 1360.0, 1760.0
MAX_UPLOAD = 30 << 20

BLOCK = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("page_no", T.IntegerType()), ("block_index", T.IntegerType()), ("x0", T.DoubleType()), ("y0", T.DoubleType()), ("x1", T.DoubleType()), ("y1", T.DoubleType()), ("text", T.StringType()), ("font_size", T.DoubleType()))]
)
SPANS = "array<struct<spans:array<struct<text:string,size:double,color:int>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_documents(documents: DataFrame) -> DataFrame:
    """One block for each line that isn't blank: 40 to a page, 20 to a column."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).filter(F.trim("text") != "")
    slot, n = F.col("line_no") % 40, F.length("text")
    col = F.floor(slot / 20)
    x0, y0 = 80 + 640 * col, 60 + 82 * (slot % 20)
    return rows.select(
        "doc_id", (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page_no"), F.col("line_no").cast("int").alias("block_index"),
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + F.least(F.lit(560), 6 * n)).cast("double").alias("x1"), (y0 + 14 + 18 * F.floor(n / 90)).cast("double").alias("y1"),
        "text", F.lit(11.0).alias("font_size"),
    )


def regions_for(blocks: DataFrame) -> DataFrame:
    """Four rectangles on each page of such blocks, of which the last shadows the first."""
    pages = blocks.select("doc_id", "page_no").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    j, d = F.col("k") % 3, F.when(F.col("k") == 3, 10 * (F.col("doc_id") % 5)).otherwise(0)
    x0, y0 = 60 + 200 * j + d, 100 + 300 * j + 7 * (F.col("doc_id") % 10)
    return pages.select("doc_id", "page_no", "k", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 400).cast("double").alias("x1"), (y0 + 150).cast("double").alias("y1"))


def block_text(lines: Column) -> Column:
    """The spans' texts, a newline after each line, cleaned."""
    joined = F.array_join(F.transform(lines, lambda line: F.concat(F.array_join(F.transform(line["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), ""), F.lit("\n"))), "")
    return clean_extracted(strip(joined))


def block_style(lines: Column) -> Column:
    """font_size (the greatest, 11 without any) and color (the first, black without any)."""
    spans = F.flatten(F.transform(lines, lambda line: line["spans"]))
    sizes = F.filter(F.transform(spans, lambda s: s["size"]), lambda x: x > 0)
    color = G.rgb(F.coalesce(F.try_element_at(spans, F.lit(1))["color"], F.lit(0)))
    return F.struct(F.coalesce(F.array_max(sizes), F.lit(11.0)).alias("font_size"), color.alias("color"))


def text_blocks(raw: DataFrame, zoom: float = G.ZOOM) -> DataFrame:
    """Blocks of text in pixels from raw ones (type, x0..y1 in points, lines): images and blank blocks are dropped."""
    own = raw.filter(F.col("type") == 0).withColumn("text", block_text(F.col("lines"))).filter(F.col("text") != "")
    return own.withColumn("_s", block_style(F.col("lines"))).select(
        "doc_id", "page_no", "block_index", *((F.col(n) * zoom).alias(n) for n in ("x0", "y0", "x1", "y1")), "text", F.col("_s.font_size").alias("font_size"), F.col("_s.color").alias("color")
    )


def uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted files, rejected ones with a reason): a .pdf name, some content, and at most 30 MB."""
    files = spark.read.format("binaryFile").load(path)
    reason = F.when(~F.lower("path").endswith(".pdf"), "not_a_pdf").when(F.col("length") == 0, "empty").when(F.col("length") > MAX_UPLOAD, "too_large")
    marked = files.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").select("path", "length", "reason")


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Raw blocks of PDF files (path, content) with PyMuPDF, where that is installed; a damaged file gives no rows."""
    schema = f"path string, page_no int, block_index int, type int, x0 double, y0 double, x1 double, y1 double, lines {SPANS}"

    def run(frames: Iterator) -> Iterator:
        import fitz
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    doc = fitz.open(stream=content, filetype="pdf")
                except Exception:
                    continue
                for page in doc:
                    rows = []
                    for k, b in enumerate(page.get_text("dict")["blocks"]):
                        lines = [{"spans": [{"text": s["text"], "size": float(s["size"]), "color": int(s["color"])} for s in x["spans"]]} for x in b.get("lines", [])]
                        rows.append((path, page.number + 1, k, b["type"], *map(float, b["bbox"]), lines))
                    yield pd.DataFrame(rows, columns=["path", "page_no", "block_index", "type", "x0", "y0", "x1", "y1", "lines"])

    return files.select("path", "content").mapInPandas(run, schema)
