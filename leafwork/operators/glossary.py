"""Glossary terms: acronyms by frequency, and their short form for a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

#: Fixed values.
TOP, PAGES, IN_PROMPT = 12, 5, 8


def top_terms(texts: DataFrame, k: int = TOP, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """term, n: the k most frequent acronyms, ties by the alphabet; with by, of each key."""
    by = by or []
    found = texts.select(*by, F.explode(F.regexp_extract_all(text, F.lit(P.GLOSSARY_TERM), F.lit(0))).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return found.orderBy(F.desc("n"), "term").limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "term")
    return found.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def first_pages(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("page_no") <= PAGES)


def compacted(terms: DataFrame, by: list[str], order: str, term: str = "term") -> DataFrame:
    """by, glossary: the first eight distinct terms, without explanations after a colon and without very long ones."""
    short = F.trim(F.element_at(F.split(term, ":", 2), 1))
    upper = F.upper(short) == short
    sound = (short != "") & ((F.length(short) <= 36) | (upper & (F.lower(short) != short) & (F.length(short) <= 64)))
    one = terms.withColumn("_t", short).filter(sound).groupBy(*by, F.upper("_t").alias("_u")).agg(F.min(F.struct(order, "_t")).alias("_f"))
    w = Window.partitionBy(*by).orderBy(f"_f.{order}", "_u") if by else Window.orderBy(f"_f.{order}", "_u")
    first = one.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= IN_PROMPT)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_f._t"))), lambda x: x["_t"]), ", ")
    return first.groupBy(*by).agg(listed.alias("glossary"))
