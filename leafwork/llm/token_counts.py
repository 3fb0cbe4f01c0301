"""Token counts: a separator scan over flat, unindexed token files.

A token file is nothing but ids, little-endian unsigned 16-bit integers, each document followed by the end-of-document id.
It has no index, so where documents lie is found by searching for that id:

1. a file comes in blocks of ids, cut at any place, a row each (file, block, data); each block is searched by itself,
   vectorised, which gives the places of its separators and a summary: how many ids and separators, and the last separator;
2. an exclusive prefix scan over a file's blocks carries into each block how many ids and documents lie before it and where
   the document that is open began. The scan has two levels, runs of ``RUN`` blocks and then the runs, so that no task needs
   all blocks of a large file;
3. lengths are the differences of successive separators, across blocks too;
4. a prefix scan over the files, in ranges of their names, makes places global.

The files are kept as a table of blocks in the shared folder, through Spark's own writer: it reaches any store that Spark
reaches, and lost attempts leave nothing behind. ``blocks_of`` makes such rows of raw files elsewhere. What names the documents
lies in another column, which a scan never reads.

The writer encodes the separator's own string, where a text has it, as ordinary text, so no document holds the id; ids that 16
bits can't hold are an error. Ids after the last separator of a file are an unfinished document: reported with ``closed`` false,
and it ends with the file. An empty file has no documents; two separators in a row hold an empty document between them. Null and
empty texts are documents of no ids. Rows with a null doc_id and repeated rows each get a row. Other columns, whatever their
names, are left alone. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

#: Ids of a block.
BLOCK = 1 << 20
#: Blocks of a run, over which one task scans.
RUN = 1024
END_ID = 50256
BLOCKS = "file string, block long, data binary"


def block_counts(ids: np.ndarray, end_id: int) -> tuple[np.ndarray, int]:
    """(lengths that end in this block, of which the first lacks what came before it; ids behind the last separator)."""
    at = np.flatnonzero(ids == end_id)
    return (np.diff(np.concatenate(([-1], at))) - 1, len(ids) - 1 - int(at[-1])) if len(at) else (np.zeros(0, np.int64), len(ids))


def scan(ids: np.ndarray, end_id: int, block: int = BLOCK) -> tuple[np.ndarray, int]:
    """(lengths of a file's finished documents, ids of an unfinished one), stitched over the blocks."""
    parts = [block_counts(ids[a : a + block], end_id) for a in range(0, len(ids), block)]
    if not parts:
        return np.zeros(0, np.int64), 0
    # Exclusive scan of (open ids): a block with a separator starts afresh, one without passes on what it got.
    carry = 0
    out = []
    for lengths, left in parts:
        if len(lengths):
            lengths = lengths.copy()
            lengths[0] += carry
            out.append(lengths)
            carry = left
        else:
            carry += left
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), carry


def write(documents: DataFrame, path: str, scratch: common.Scratch, end_id: int = END_ID, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Writes the texts as flat files. (files: file, block, data; order: file, ordinal, doc_id, which only names the documents).

    A task writes one file, in blocks cut wherever ``block`` ids are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = bpe.library_chunks(path, special=False)  # so that no text holds the separator
        name, held, size, at, ordinal, docs = None, [], 0, 0, 0, []

        def row(ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([ordinal], pa.int64()), pa.array([docs], pa.list_(pa.int64()))], names=["file", "block", "data", "ordinal", "doc_ids"])

        for b in batches:
            if name is None:
                name = f"{b.column('task')[0].as_py():08d}.u16"
            texts = common.encoded(b.column("text"))
            found = (x for a, z in common.steps(texts) for x in chunks.many(texts[a:z]))
            for d, x in zip(b.column("doc_id").to_pylist(), found):
                if len(x) and int(x.max()) >= 1 << 16:
                    raise ValueError(f"id {int(x.max())} does not fit into 16 bits")
                held.append(np.append(x, np.uint32(end_id)).astype("<u2"))
                size += len(held[-1])
                docs.append(d)
                while size >= block:
                    ids = np.concatenate(held)
                    yield row(ids[:block])
                    held, size, at, ordinal, docs = [ids[block:]], size - block, at + 1, ordinal + len(docs), []
        if size or docs:
            yield row(np.concatenate(held))

    source = common.row_key(documents).withColumn("task", F.spark_partition_id())
    made = scratch.write(source.mapInArrow(common.frugal(run), f"{BLOCKS}, ordinal long, doc_ids array<long>"), "flat", large=True)
    order = made.select("file", "ordinal", F.posexplode("doc_ids").alias("k", "doc_id"))
    return made.select("file", "block", "data"), order.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "doc_id")


def blocks_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, data) of raw flat files, of up to 2 GB each, in any store that Spark reads."""
    raw = spark.read.format("binaryFile").load(path)
    cut = F.expr(f"explode(sequence(0L, greatest(0L, (length - 1) div {2 * BLOCK})))")
    return raw.select(F.col("path").alias("file"), "content", cut.alias("block")).select("file", "block", F.expr(f"substring(content, cast(block * {2 * BLOCK} + 1 as int), {2 * BLOCK})").alias("data"))


def _searched(end_id: int, block: int | None):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, k, data in zip(batch.column("file"), batch.column("block").to_pylist(), batch.column("data")):
            ids = np.frombuffer(data.as_buffer(), "<u2") if data.is_valid and len(data.as_buffer()) > 1 else np.zeros(0, "<u2")
            step = block or max(1, len(ids))
            for j, a in enumerate(range(0, max(1, len(ids)), step)):
                part = ids[a : a + step]
                at = np.flatnonzero(part == end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()]), pa.array([k], pa.int64()), pa.array([j], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([at], pa.list_(pa.int32()))],
                    names=["file", "block", "part", "n", "ends"],
                )

    return common.by_batch(run)


def _carried(blocks: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Adds to a file's blocks what lies before them in the file: ids, documents, and the last separator's place (-1: none)."""
    s = blocks.select("file", "block", "part", "n", F.size("ends").cast("long").alias("k"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    s = s.withColumn("run", F.floor(F.col("block") / RUN))
    inner, before = Window.partitionBy("file", "run").orderBy("block", "part"), (Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(*before)), F.lit(0))
    s = s.withColumn("ids", total("n", inner)).withColumn("docs", total("k", inner)).withColumn("place", F.col("ids") + F.col("last"))
    s = scratch.write(s.withColumn("open", F.max("place").over(inner.rowsBetween(*before))).drop("n"), "scanned")
    runs = blocks.withColumn("run", F.floor(F.col("block") / RUN)).groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum(F.size("ends")).alias("k"))
    runs = runs.join(s.groupBy("file", "run").agg(F.max("place").alias("place")), ["file", "run"])
    outer = Window.partitionBy("file").orderBy("run")
    runs = runs.withColumn("ids0", total("n", outer)).withColumn("docs0", total("k", outer)).withColumn("place", F.col("ids0") + F.col("place"))
    runs = runs.withColumn("open0", F.max("place").over(outer.rowsBetween(*before))).select("file", "run", "ids0", "docs0", "open0")
    joined = s.join(runs, ["file", "run"])
    opened = F.coalesce(F.col("ids0") + F.col("open"), F.col("open0"), F.lit(-1))
    return joined.select("file", "block", "part", (F.col("ids0") + F.col("ids")).alias("ids"), (F.col("docs0") + F.col("docs")).alias("docs"), opened.alias("open"))


def count(files: DataFrame, end_id: int = END_ID, block: int | None = None, scratch: common.Scratch | None = None) -> DataFrame:
    """file, ordinal (in the file), n_tokens, offset (of its first id in the file), closed for each document of flat files.

    files: their blocks (file, block, data), of any sizes, in the order of block; ``block`` cuts them further.
    """
    scratch = scratch or common.Scratch(files.sparkSession, "separators")
    found = scratch.write(files.select("file", F.col("block").cast("long").alias("block"), "data").mapInArrow(_searched(end_id, block), "file string, block long, part long, n long, ends array<int>"), "ends")
    both = found.join(_carried(found, scratch), ["file", "block", "part"])
    at = F.transform("ends", lambda x: F.col("ids") + x)
    each = both.select("file", "ids", "docs", "open", F.posexplode(F.arrays_zip(at.alias("end"), F.concat(F.array("open"), at).alias("behind"))).alias("k", "x")).filter("x.end is not null")
    begin = F.col("x.behind") + 1
    closed = each.select("file", (F.col("docs") + F.col("k")).alias("ordinal"), (F.col("x.end") - begin).alias("n_tokens"), begin.alias("offset"), F.lit(True).alias("closed"))
    ends = both.select("file", (F.col("ids") + F.col("n")).alias("n"), (F.col("docs") + F.size("ends")).alias("docs"), F.when(F.size("ends") > 0, F.col("ids") + F.element_at("ends", -1)).otherwise(F.col("open")).alias("open"))
    last = ends.groupBy("file").agg(F.max("n").alias("n"), F.max("docs").alias("docs"), F.max("open").alias("open")).filter("n > open + 1")
    unfinished = last.select("file", F.col("docs").alias("ordinal"), (F.col("n") - F.col("open") - 1).alias("n_tokens"), (F.col("open") + 1).alias("offset"), F.lit(False).alias("closed"))
    return closed.unionByName(unfinished)


def placed(counts: DataFrame, scratch: common.Scratch | None = None) -> DataFrame:
    """Adds start: the ids of all documents before, in the order of the files' names, without separators."""
    scratch = scratch or common.Scratch(counts.sparkSession, "places")
    totals = counts.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = common.running(totals, "file", "n", "base", scratch)
    return counts.join(base.select("file", "base"), "file").withColumn("start", F.col("base") + F.col("offset") - F.col("ordinal")).drop("base")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens for each document, read off flat files of all texts by their separators."""
    scratch = common.Scratch(spark, "flat")
    files, order = write(common.table(spark, sf_dir, "documents"), bpe.tokenizer_path(), scratch)
    counts = count(files, scratch=scratch)
    done = scratch.write(counts.join(order, ["file", "ordinal"], "full").select("doc_id", "n_tokens", F.col("n_tokens").isNull().alias("lost")), "done")
    if done.filter("lost").take(1) or done.count() != order.count():
        raise ValueError("the files don't hold as many documents as were written")
    scratch.drop("flat", "ends", "scanned")
    return done.select("doc_id", "n_tokens")
