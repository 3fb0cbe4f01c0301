"""Text in images: recognised lines, their translation, and whether it fits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as is_
from ..functions import replies as R
from ..functions.text import compact, with_view
from ..sources import external
from . import layout
from .translate import Options, Provider, ask

KEY = ["doc_id", "page_no", "image_index"]
_OUT = "doc_id long, page_no int, image_index int, text string, translation string, font double, lines array<string>, from_provider string, to_provider string, reason string"


def lines_of(local: DataFrame, remote: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, text, x0..y1 of the lines of each image: the local recogniser's, else the remote one's text over the whole image.

    local: rec_texts, rec_polys. remote: raw JSON lines. sizes: width, height.
    """
    own = external.ocr_lines(local, KEY)
    rest = remote.select(*KEY, external.markdown_from_jsonl(F.col("raw")).alias("text")).filter(F.col("text") != "").join(own.select(*KEY).distinct(), KEY, "left_anti")
    whole = rest.join(sizes, KEY).select(*KEY, "text", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").cast("int").alias("x1"), F.col("height").cast("int").alias("y1"))
    return own.unionByName(whole)


def translate_lines(lines: DataFrame, providers: list[Provider], options: Options) -> DataFrame:
    """key, text, translation and its fitted lines, switch of providers, reason (null where it is set) of lines worth translating."""
    df, v = with_view(lines.withColumn("_compact", compact(F.trim("text"))), "_compact")
    wanted = df.filter(is_.translatable(v)).select(*KEY, F.trim("text").alias("text"), *(F.col(n).cast("double").alias(n) for n in ("x0", "y0", "x1", "y1")))

    def one(text: str, w: float, h: float) -> tuple:
        try:
            out, used, left = ask([text], providers, options)
        except R.ReplyError as e:
            return None, None, None, None, None, f"image_text_translation_failed: {e}"
        fit = layout.fit(out[0], w, h, max(10.0, h * 0.7), layout.Tier(0.7, 8.0, 1.2, 1.08))
        return (out[0], fit.font, fit.lines, left, used if left else None, None) if fit else (out[0], None, None, left, used if left else None, "image_text_overflow")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [one(t, max(1.0, x1 - x0), max(1.0, y1 - y0)) for t, x0, y0, x1, y1 in zip(f["text"], f["x0"], f["y0"], f["x1"], f["y1"])]
            yield f[[*KEY, "text"]].assign(**{n: [x[k] for x in found] for k, n in enumerate(("translation", "font", "lines", "from_provider", "to_provider", "reason"))})

    return wanted.mapInPandas(run, _OUT)
