"""Benchmark decontamination: Wu-Manber search of documents for windows of benchmark words.

Symbols are words. Windows of equal length m form one search: a table, indexed by a hash of two successive words, gives how far
the search may shift when these end at the place it looks at (words in no window allow m - 1; where hashes meet, the lesser
shift holds, which is safe). A shift of 0 selects the bucket of the windows that end with these words, a range of arrays sorted
by suffix hash and window hash, and direct comparison with the benchmark's own text confirms each. Long texts with nothing in
common with a benchmark are read at one look for every m - 1 words.

The tables are flat arrays of about 55 bytes a benchmark word. Benchmarks with tables of more than ``MAX_TABLE_BYTES`` are
searched in blocks of at most that size, one after another; the occurrences are united before they are counted. At most
``CHAIN`` blocks are searched in one pass; what they found is written to the shared folder before the next.

Null and empty texts have no words. An item without words has no window. Items with equal windows each count. Repeated rows
each get a row. Item ids that are null are void. Empty tables on either side are no error. Other columns, whatever their names,
are left alone.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 10
MAX_TABLE_BYTES = 32 << 20
#: Bytes of tables for each word, at most: places, hashes, shifts.
WORD_BYTES = 64
CHAIN = 2
FOUND = "array<struct<first:int,last:int,item:string>>"


class Search:
    """Tables for all windows of one length: items are (item id, words) of at least that many words, or exactly that many where they are shorter than a window."""

    def __init__(self, length: int, items: list[tuple[str, list[bytes]]]):
        m = self.length = length
        b = self.block = min(2, m)
        self.items = [i for i, _ in items]
        self.text = b" ".join(w for _, words in items for w in words)
        sizes = np.fromiter((len(w) for _, words in items for w in words), np.int64) + 1
        self.ends = array("q", (np.cumsum(sizes) - 1).tobytes())
        n = np.array([len(words) for _, words in items])
        first = np.cumsum(n) - n
        ending = np.fromiter((hash(tuple(words[e - b : e])) for _, words in items for e in range(b, len(words) + 1)), np.int64)
        place = np.concatenate([np.arange(b, k + 1) for k in n])  # words up to the end of each
        bits = max(10, int(len(ending) * 16 - 1).bit_length())
        self.mask = (1 << min(bits, 26)) - 1
        shift = np.full(self.mask + 1, m - b + 1, np.uint8)
        np.minimum.at(shift, ending & self.mask, np.maximum(0, m - place).astype(np.uint8))
        self.shift = shift.tobytes()
        whole = np.fromiter((hash(tuple(words[a : a + m])) for _, words in items for a in range(len(words) - m + 1)), np.int64)
        suffix = ending[place >= m]
        start = np.concatenate([f + np.arange(k - m + 1) for f, k in zip(first, n)])
        item = np.repeat(np.arange(len(items)), n - m + 1)
        order = np.lexsort((item, whole, suffix))
        self.suffix, self.whole = array("q", suffix[order].tobytes()), array("q", whole[order].tobytes())
        self.start, self.item = array("q", start[order].tobytes()), array("i", item[order].astype(np.int32).tobytes())

    def _confirm(self, words: list[bytes], at: int, h: int, found: list[tuple[int, int, str]]) -> None:
        first = at - self.length + 1
        k = bisect_left(self.suffix, h)
        if k == len(self.suffix) or self.suffix[k] != h:
            return
        window = words[first : at + 1]
        whole = hash(tuple(window))
        k = bisect_left(self.whole, whole, k, bisect_left(self.suffix, h + 1, k) if h < (1 << 63) - 1 else len(self.suffix))
        text, seen = b" ".join(window), set()
        while k < len(self.whole) and self.whole[k] == whole and self.suffix[k] == h:
            a, i = self.start[k], self.item[k]
            if i not in seen and self.text[self.ends[a - 1] + 1 if a else 0 : self.ends[a + self.length - 1]] == text:
                seen.add(i)
                found.append((first, at, self.items[i]))
            k += 1

    def run(self, words: list[bytes], found: list[tuple[int, int, str]]) -> None:
        at, n, shift, mask = self.length - 1, len(words), self.shift, self.mask
        if self.block == 1:
            for at in range(n):
                h = hash((words[at],))
                if not shift[h & mask]:
                    self._confirm(words, at, h, found)
            return
        while at < n:
            h = hash((words[at - 1], words[at]))
            if step := shift[h & mask]:
                at += step
            else:
                self._confirm(words, at, h, found)
                at += 1


def searches(items: list[tuple[str, str]], width: int = WIDTH) -> list[Search]:
    by: dict[int, list] = {}
    for item, text in items:
        if words := common.words_of(text):
            by.setdefault(min(width, len(words)), []).append((item, words))
    return [Search(m, own) for m, own in by.items()]


_tables: dict = {}


def _searches(block) -> list[Search]:
    """Built once for each Python worker."""
    if block.id not in _tables:
        _tables.clear()
        _tables[block.id] = searches(block.items.value)
    return _tables[block.id]


class Block:
    def __init__(self, spark: SparkSession, items: list[tuple[str, str]], number: int):
        self.items = spark.sparkContext.broadcast(items)
        self.id = (self.items._jbroadcast.id() if hasattr(self.items, "_jbroadcast") else id(items), number)

    def __getstate__(self):
        return {"items": self.items, "id": self.id}


def blocks(spark: SparkSession, benchmark: DataFrame, most: int) -> list[Block]:
    """The benchmark in blocks whose tables have a bounded size; it streams through the driver, which holds one block at a time."""
    out, now, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).dropna().distinct()
    for i, t in rows.toLocalIterator():
        now.append((i, t))
        size += len(t.encode()) + WORD_BYTES * (1 + len(common.words_of(t)))
        if size > most:
            out.append(Block(spark, now, len(out)))
            now, size = [], 0
    return [*out, Block(spark, now, len(out))] if now or not out else out


def find(documents: DataFrame, benchmark: DataFrame, max_table_bytes: int = MAX_TABLE_BYTES) -> DataFrame:
    """doc_id, found (first and last word of each occurrence, item), n_words, n_hit, n_items, items_sha256, contaminated for each row."""
    spark = documents.sparkSession
    common.prepare(spark)
    parts = blocks(spark, benchmark, max_table_bytes)
    df, scratch = common.row_key(documents), None
    for k, part in enumerate(parts[:-1]):
        df = df.mapInArrow(_partial(part, k > 0), f"doc_id long, text string, found {FOUND}")
        if k % CHAIN == CHAIN - 1:
            scratch = scratch or common.Scratch(spark, "decontaminate")
            df = scratch.write(df, f"found-{k}")
            scratch.drop(f"found-{k - CHAIN}")
    last = f"doc_id long, found {FOUND}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return df.mapInArrow(_final(parts[-1], len(parts) > 1), last)


_FOUND_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))


def _earlier(b: pa.RecordBatch, has: bool) -> list[list[tuple[int, int, str]]]:
    return [[(x["first"], x["last"], x["item"]) for x in row] for row in b.column("found").to_pylist()] if has else [[] for _ in range(b.num_rows)]


def _spans(found: list[list[tuple[int, int, str]]]) -> pa.Array:
    return pa.array([[{"first": a, "last": z, "item": i} for a, z, i in row] for row in found], _FOUND_ARROW)


def _partial(part: Block, more: bool):
    def run(b: pa.RecordBatch):
        tables, found = _searches(part), _earlier(b, more)
        for text, row in zip(b.column("text"), found):
            words = common.words_of(text.as_py())
            for s in tables:
                s.run(words, row)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), _spans(found)], names=["doc_id", "text", "found"])

    return common.by_batch(run)


def _final(part: Block, more: bool):
    def run(b: pa.RecordBatch):
        tables, found = _searches(part), _earlier(b, more)
        counts = []
        for text, row in zip(b.column("text"), found):
            words = common.words_of(text.as_py())
            for s in tables:
                s.run(words, row)
            hit, end = 0, -1
            for first, last, _ in sorted(row):
                hit += max(0, last - max(first - 1, end))
                end = max(end, last)
            items = sorted({x for _, _, x in row})
            counts.append((len(words), hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0))
        cols = [pa.array(c, t) for c, t in zip(zip(*counts), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _spans(found), *cols], names=["doc_id", "found", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return common.by_batch(run)


def clean(documents: DataFrame, benchmark: DataFrame, max_table_bytes: int = MAX_TABLE_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    spark = documents.sparkSession
    common.prepare(spark)

    def kept(part: Block):
        def run(b: pa.RecordBatch):
            tables, rows = _searches(part), []
            for k, text in enumerate(b.column("text")):
                words, found = common.words_of(text.as_py()), []
                for s in tables:
                    s.run(words, found)
                    if found:
                        break
                if not found:
                    rows.append(k)
            if rows:
                yield b.take(pa.array(rows, pa.int64()))

        return common.by_batch(run)

    scratch = None
    for k, part in enumerate(blocks(spark, benchmark, max_table_bytes)):
        if k and k % CHAIN == 0:
            scratch = scratch or common.Scratch(spark, "decontaminate")
            documents = scratch.write(documents, f"kept-{k}")
            scratch.drop(f"kept-{k - CHAIN}")
        documents = documents.mapInArrow(kept(part), documents.schema)
    return documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM iw WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, ws, len(ws) AS n, unnest(generate_series(1, len(ws))) AS i FROM w WHERE len(ws) > 0),
occ AS (
  SELECT p.doc_id, p.i, l.m, win.item_id FROM pos p JOIN lens l ON p.i + l.m - 1 <= p.n
  JOIN win ON win.m = l.m AND win.win = array_to_string(p.ws[p.i : p.i + l.m - 1], ' ')
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM occ) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY 1
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""
