"""Ordered work on the blocks of a page: merging fragments, packing batches, distinct texts, the memory of translations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from ..functions import plain_predicates as plain
from ..functions import predicates as is_
from ..functions.geometry import Rect
from ..functions.text import collapse, fingerprint, strip, words

PAGE = ["doc_id", "page_no"]

# Fixed values.
MAX_GROUP, MAX_MERGED_HEIGHT = 3, 260.0
MAX_BLOCKS, MAX_CHARS = 36, 8000
COMPAT_BLOCKS, COMPAT_CHARS = 18, 3600


def mergeable(a: Rect, b: Rect, a_text: Column, b_text: Column, page_width: Column) -> Column:
    """Whether fragment b, which follows a in its column, belongs to a's paragraph. Texts are collapsed."""
    gap, shared = b.y0 - a.y1, G.horizontal_overlap(a, b)
    goes_on = is_.continues(a_text, b_text)
    one = F.lit(1.0)
    aw, bw, ah, bh = (F.greatest(one, x) for x in (a.width, b.width, a.height, b.height))
    narrow, left, right = F.greatest(one, F.least(aw, bw)), F.abs(a.x0 - b.x0), F.abs(a.x1 - b.x1)
    overlaid = (gap < -2.5) & (shared >= 0.90) & goes_on
    edges = F.when(overlaid, (left <= F.greatest(F.lit(34.0), narrow * 0.18)) & (right <= F.greatest(F.lit(190.0), narrow * 0.62))).otherwise(
        (left <= F.greatest(F.lit(24.0), narrow * 0.10)) & (right <= F.greatest(F.lit(30.0), narrow * 0.12))
    )
    notation = (is_.notation_line(a_text) | is_.notation_line(b_text)) & (gap >= -1.0)
    a_words, b_words = words(a_text), words(b_text)
    prose = ((ah >= 44.0) & (bh >= 44.0) & (a_words >= 18) & (b_words >= 18)) | ((ah > 72.0) & (bh > 72.0) & (a_words > 55) & (b_words > 55))
    most = F.greatest(F.lit(10.0), F.least(F.lit(30.0), F.greatest(ah, bh) * 0.38 + 12.0))
    return (
        (G.half(a, page_width) == G.half(b, page_width)) & (F.greatest(ah, bh) <= MAX_MERGED_HEIGHT) & (a_text != "") & (b_text != "")
        & ~is_.heading_line(a_text) & ~is_.heading_line(b_text) & (shared >= 0.68) & edges
        & ~(notation & (~goes_on | (gap > 8.5))) & ((gap >= -2.5) | ((gap >= -42.0) & (shared >= 0.92) & goes_on)) & (gap <= most) & ~prose
    )


def pairs(blocks: DataFrame, page_width: float) -> DataFrame:
    """The blocks with ``follows``: whether each belongs to the one before it in its column."""
    width = F.lit(float(page_width))
    own = blocks.withColumn("_half", G.half(Rect.of(), width)).withColumn("_flat", collapse(F.col("text")))
    w = Window.partitionBy(*PAGE).orderBy("_half", "block_index", "y0", "x0")
    before = {f"_b_{n}": F.lag(n).over(w) for n in ("x0", "y0", "x1", "y1", "_flat")}
    own = own.withColumns(before | {"_order": F.row_number().over(w)})
    follows = F.col("_b_x0").isNotNull() & mergeable(Rect.of("_b_"), Rect.of(), F.col("_b__flat"), F.col("_flat"), width)
    return own.withColumn("follows", F.coalesce(follows, F.lit(False))).drop(*before, "_half", "_flat")


def merge_fragments(blocks: DataFrame, page_width: float) -> DataFrame:
    """Merges runs of following fragments: at most three, and 260 pixels high together.

    The test of neighbours needs only the block before, so a window gives it; the caps need a fold over a page's blocks.
    The merged block has the index and colour of its first, the greatest font, and the union of the rectangles; a hyphen at
    the end of a part is closed up.
    """
    marked = pairs(blocks, page_width)
    item = F.struct("_order", "follows", "y0", "y1", "block_index")
    zero = F.struct(F.array().cast("array<struct<block_index:int,grp:int>>").alias("out"), F.lit(0).alias("grp"), F.lit(0).alias("n"), F.lit(0.0).alias("top"), F.lit(0.0).alias("foot"))

    def step(s: Column, b: Column) -> Column:
        high = F.greatest(s["foot"], b["y1"]) - F.least(s["top"], b["y0"])
        joins = (s["n"] > 0) & (s["n"] < MAX_GROUP) & b["follows"] & (high <= MAX_MERGED_HEIGHT)
        grp = F.when(joins, s["grp"]).otherwise(s["grp"] + 1)
        entry = F.struct(b["block_index"].cast("int").alias("block_index"), grp.alias("grp"))
        return F.struct(
            F.array_append(s["out"], entry).alias("out"), grp.alias("grp"), F.when(joins, s["n"] + 1).otherwise(1).alias("n"),
            F.when(joins, s["top"]).otherwise(b["y0"]).alias("top"), b["y1"].alias("foot"),
        )

    folded = marked.groupBy(*PAGE).agg(F.aggregate(F.array_sort(F.collect_list(item)), zero, step, lambda s: s["out"]).alias("out"))
    groups = folded.select(*PAGE, F.explode("out").alias("g")).select(*PAGE, "g.block_index", "g.grp")
    joined = marked.drop("_order", "follows").join(groups, [*PAGE, "block_index"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: strip(x["text"]))

    def glue(out: Column, part: Column) -> Column:
        closed = F.concat(F.rtrim(F.substring(out, F.lit(1), F.length(out) - 1)), F.ltrim(part))
        return F.when(part == "", out).when(out == "", part).when(out.endswith("-"), closed).otherwise(F.concat(out, F.lit("\n"), part))

    rest = [c for c in blocks.columns if c not in {*PAGE, "block_index", "text", "x0", "y0", "x1", "y1", "width", "height", "base_font_size"}]
    font = [F.max("base_font_size").alias("base_font_size")] if "base_font_size" in blocks.columns else []
    merged = joined.groupBy(*PAGE, "grp").agg(
        F.min("block_index").alias("block_index"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.aggregate(parts, F.lit(""), glue).alias("text"),
        F.count(F.lit(1)).alias("n_parts"), *font, *(F.min_by(c, "block_index").alias(c) for c in rest),
    )
    return merged.drop("grp").withColumns({"width": F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), "height": F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))})


_ENTRY = "doc_id long, page_no int, block_index int, x0 double, y0 double, x1 double, y1 double, width double, height double, base_font_size double, n_parts int, text string, prompt string, facts struct<keeps:boolean,n:int,words:int,items:int,marks:int>"


def by_page(rows: DataFrame) -> DataFrame:
    """rows with those of a page next to each other, by block_index: one shuffle and a sort."""
    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "block_index")


def pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(doc_id, page_no) and the rows of each page, of batches whose first two columns these are."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for page, own in groupby(rows, key=itemgetter(0, 1)):
        yield page, list(own)


def in_batches(rows: Iterator[tuple], to: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a schema."""
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), to)], schema=to)


def merged_pages(jobs: DataFrame, texts: DataFrame, page_width: float) -> DataFrame:
    """merge_fragments of admitted blocks (rectangle, base_font_size), page by page in plain functions, with what translating needs.

    texts: block_index and text of all blocks. They meet jobs by a union, not a join: a text is shuffled once. Of a merged
    block come prompt (the compacted text; null where it is the text itself) and facts (what setting its translation needs).
    """
    none = lambda t: F.lit(None).cast(t)
    sides = [F.col(n).cast("double").alias(n) for n in ("x0", "y0", "x1", "y1", "base_font_size")]
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), F.col("block_index").cast("int").alias("block_index")]
    known = jobs.select(*key, F.lit(True).alias("job"), *sides, none("string").alias("text"))
    both = known.unionByName(texts.select(*key, F.lit(False).alias("job"), *(none("double").alias(n) for n in ("x0", "y0", "x1", "y1", "base_font_size")), "text"))
    schema = to_arrow_schema(T._parse_datatype_string(_ENTRY))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for page, rows in pages_of(batches):
            said = {r[2]: r[9] for r in rows if not r[3]}
            own = [plain.Fragment(r[2], r[4:9], said[r[2]], page_width) for r in rows if r[3]]
            for run in plain.merged(own, MAX_GROUP, MAX_MERGED_HEIGHT):
                run.sort(key=lambda b: b.block_index)
                text = plain.glued([b.text.strip() for b in run])
                x0, y0, x1, y1 = min(b.x0 for b in run), min(b.y0 for b in run), max(b.x1 for b in run), max(b.y1 for b in run)
                prompt = plain.compact(text)
                facts = dict(zip(("keeps", "n", "words", "items", "marks"), plain.facts(text)))
                yield *page, run[0].block_index, x0, y0, x1, y1, max(1.0, x1 - x0), max(1.0, y1 - y0), max(b.font for b in run), len(run), text, None if prompt == text else prompt, facts

    return by_page(both).mapInArrow(lambda batches: in_batches(blocks(batches), schema), _ENTRY)


def long_limit(max_chars: int) -> int:
    """Texts from this length on are batches of their own."""
    return max(760, min(980, int(max_chars * 0.30)))


def packed(sizes: list[int], max_blocks: int = MAX_BLOCKS, max_chars: int = MAX_CHARS) -> list[int]:
    """pack over the characters of one page's rows, in order."""
    out, limit = [], long_limit(max_chars)
    batch = n = size = 0
    for chars in sizes:
        alone = chars >= limit
        if alone or n == 0 or n >= max_blocks or size + chars > max_chars:
            batch, n, size = batch + 1, 0, 0
        if not alone:
            n, size = n + 1, size + chars
        out.append(batch)
    return out


def pack(rows: DataFrame, key: list[str], order: list[str], chars: str, max_blocks: int = MAX_BLOCKS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Adds batch (from 1, in each key): greedy packing in order, with caps on blocks and characters; long texts go alone.

    order must be unique within key, or what follows it in the row decides.
    """
    others = [c for c in rows.columns if c not in {*key, *order, chars}]
    item = F.struct(*order, F.col(chars).alias("_chars"), *others)
    limit = long_limit(max_chars)
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"))

    def step(s: Column, r: Column) -> Column:
        n = r["_chars"].cast("long")
        alone = n >= limit
        fresh = alone | (s["n"] == 0) | (s["n"] >= max_blocks) | (s["size"] + n > max_chars)
        batch = F.when(fresh, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(
            F.array_append(s["out"], batch).alias("out"), batch.alias("batch"), F.when(alone, 0).when(fresh, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(alone, F.lit(0).cast("long")).when(fresh, n).otherwise(s["size"] + n).alias("size"),
        )

    grouped = rows.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("all"))
    zipped = F.zip_with("all", F.aggregate("all", zero, step, lambda s: s["out"]), lambda r, b: F.struct(r.alias("r"), b.alias("batch")))
    flat = grouped.select(*key, F.explode(zipped).alias("x"))
    return flat.select(*key, *(F.col(f"x.r.{c}").alias(c) for c in order), F.col("x.r._chars").alias(chars), *(F.col(f"x.r.{c}").alias(c) for c in others), F.col("x.batch").alias("batch"))


def distinct_texts(rows: DataFrame, key: list[str], text: str, order: list[str]) -> DataFrame:
    """fp (fingerprint), the text, n (rows that have it) and the first row's order columns for each distinct text of a key."""
    first = F.min(F.struct(*order, text)).alias("f")
    found = rows.withColumn("fp", fingerprint(F.col(text))).groupBy(*key, "fp").agg(first, F.count(F.lit(1)).alias("n"))
    return found.select(*key, "fp", "n", *(F.col(f"f.{c}").alias(c) for c in order), F.col(f"f.{text}").alias(text))


def memory_lookup(rows: DataFrame, memory: DataFrame, key: list[str]) -> DataFrame:
    """rows (with fp) and translation: what the memory has for them, null where it has nothing or an empty text."""
    known = memory.filter(F.col("translation") != "").select(*key, "fp", "translation")
    return rows.join(known, [*key, "fp"], "left")


def memory_merge(memory: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """The memory after an upsert: the newest entry of a fingerprint wins, and of equally new ones the update's."""
    both = memory.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return both.groupBy(*key, "fp").agg(F.max_by(F.struct("translation", "updated_at"), F.struct("updated_at", "_new", "translation")).alias("m")).select(*key, "fp", "m.translation", "m.updated_at")


def memory_delete(memory: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return memory.join(gone.select(*key, "fp").distinct(), [*key, "fp"], "left_anti")


def memory_clear(memory: DataFrame, sessions: DataFrame) -> DataFrame:
    return memory.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def fan_out(rows: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Every row gets the result of its distinct text."""
    return rows.join(results, [*key, "fp"], "left")


def render_order(blocks: DataFrame) -> DataFrame:
    """Adds draw (from 1): top to bottom, left to right, larger blocks first."""
    area = F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", area.desc(), "block_index")
    return blocks.withColumn("draw", F.row_number().over(w))
