"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """Each larger neighbour of a vertex is linked to the least vertex of its neighbourhood.

    The least ones are a written table, so that a vertex with very many neighbours is a skewed key of a plain join of two
    shuffles, which Spark splits.
    """
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = scratch.write(least, name)
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(id, root) of every vertex of edges (a, b): root is the least id of its component.

    Alternates large and small stars until nothing changes; each round's edges are written to the shared folder. Only two
    numbers for each round reach the driver.
    """
    now, before, k = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b"), None, 0
    while True:
        now = scratch.write(_small_star(_large_star(now, scratch, f"{name}-{k}-least")), f"{name}-{k}")
        scratch.drop(f"{name}-{k}-least")
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if k:
            scratch.drop(f"{name}-{k - 1}")
        if state == before:
            break
        before, k = state, k + 1
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
