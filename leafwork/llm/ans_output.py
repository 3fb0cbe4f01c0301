"""Token-ID output in a static range asymmetric numeral system.

One frequency table, counted over all tokens of the output, serves every file. A file holds blocks of ``BLOCK`` tokens that
are coded independently; within a block, ``LANES`` states take turns over the tokens and share one stream of 32-bit words.
Every ``EVERY`` tokens a checkpoint holds the lanes' states and the place in the stream, so decoding can start there: all
stretches between checkpoints of a file are decoded side by side. Each block has a checksum of its ids.

File: magic, then a header of JSON (with the name of the table), then per-document sizes and ids, then blocks' directory,
checkpoints and words, each deflated or raw as the header says. Documents are in ascending doc_id order, within a file and
over the files in the order of the manifest. A file is a row of a table in the shared folder (its name and its bytes), written
by Spark's own writer: it reaches any store that Spark reaches, and lost attempts leave nothing behind.

The frequency table sums to 2**20, each symbol of the vocabulary has at least 1, so any id can be coded.
Null and empty texts have the end id only. Rows with a null doc_id come first; rows of one doc_id are in the order of their
texts' first ``TIE_CHARS`` characters, then of a hash of the text, so ranges may split them; repeated rows each are a document.
An empty table gives no files. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

END_ID = 0
BITS = 20
BLOCK = 1 << 16
LANES = 64
EVERY = 1 << 13
#: Tokens of a file; a longer document is not split.
FILE_TOKENS = 2 << 20
#: Ranges whose starts are broadcast.
MOST_RANGES = 1 << 18
#: Characters of a text that order rows of one doc_id.
TIE_CHARS = 64
MAGIC = b"LWANS001"
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 each, from counts of all symbols."""
    total, room = max(1, int(counts.sum())), (1 << BITS) - len(counts)
    if room < 0:
        raise ValueError("more symbols than the table has room for")
    f = 1 + counts.astype(np.int64) * room // total
    rest = (1 << BITS) - int(f.sum())
    f[int(np.argmax(counts))] += rest
    return f.astype(np.uint32)


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.f)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.f), dtype=np.uint32), frequencies)

    def encode(self, ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(words of each block, states at checkpoints [block, checkpoint, lane], places in the block's words).

        All blocks are coded in step. The last block is filled with its last symbol up to a whole turn of the lanes.
        """
        n_blocks = max(1, -(-len(ids) // BLOCK))
        turns, per = BLOCK // LANES, EVERY // LANES
        padded = np.zeros(n_blocks * BLOCK, np.int64)
        padded[: len(ids)] = ids
        grid = padded.reshape(n_blocks, turns, LANES)
        used = np.minimum(np.maximum(len(ids) - np.arange(n_blocks) * BLOCK, 1), BLOCK)
        last_turn = -(-used // LANES)
        x = np.full((n_blocks, LANES), _LOW, np.uint64)
        words = np.zeros((n_blocks, BLOCK + LANES), np.uint32)
        at = np.full(n_blocks, BLOCK + LANES, np.int64)  # words are put from the end, as coding goes backwards
        states = np.zeros((n_blocks, turns // per, LANES), np.uint64)
        places = np.zeros((n_blocks, turns // per), np.int64)
        scale = np.uint64((int(_LOW) >> BITS) << 32)
        bits, every, short = np.uint64(BITS), slice(None), int(last_turn.min())
        for turn in range(turns - 1, -1, -1):
            live = every if turn < short else np.flatnonzero(last_turn > turn)
            if live is every or len(live):
                s = grid[live, turn]
                f, y = self.f[s], x[live]
                full = y >= scale * f
                if full.any():
                    counts = full.sum(axis=1)
                    at[live] -= counts
                    rank = np.cumsum(full, axis=1) - 1
                    b, lane = np.nonzero(full)
                    own = b if live is every else live[b]
                    words[own, at[own] + rank[b, lane]] = (y[b, lane] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    y[full] >>= _32
                q = y // f
                x[live] = (q << bits) + (y - q * f) + self.cum[s]
            if turn % per == 0:
                states[:, turn // per] = x
                places[:, turn // per] = at
        return [words[b, at[b] :] for b in range(n_blocks)], states, places - at[:, None]

    def decode(self, words: np.ndarray, starts: np.ndarray, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Decodes stretches side by side: [stretch, turn, lane] of ids. starts: of each stretch in words; turns: of each."""
        x, at = states.copy(), starts.astype(np.int64).copy()
        most = int(turns.max(initial=0))
        out = np.zeros((len(states), most, LANES), np.uint32)
        mask, bits, every, short = np.uint64((1 << BITS) - 1), np.uint64(BITS), slice(None), int(turns.min(initial=0))
        for turn in range(most):
            live = every if turn < short else np.flatnonzero(turns > turn)
            y = x[live]
            slot = y & mask
            s = self.symbol[slot]
            out[live, turn] = s
            y = self.f[s] * (y >> bits) + slot - self.cum[s]
            need = y < _LOW
            if need.any():
                rank = np.cumsum(need, axis=1) - 1
                b, lane = np.nonzero(need)
                own = b if live is every else live[b]
                y[b, lane] = y[b, lane] << _32 | words[at[own] + rank[b, lane]].astype(np.uint64)
                at[live] += need.sum(axis=1)
            x[live] = y
        return out


def pack(coder: Coder, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, table: str = "") -> bytes:
    """A whole file. sizes: of each document, with its end id."""
    words, states, places = coder.encode(ids)
    sums = [zlib.crc32(ids[k : k + BLOCK].astype("<u4").tobytes()) for k in range(0, max(1, len(ids)), BLOCK)]
    parts = [
        zlib.compress(json.dumps(doc_ids).encode()), zlib.compress(sizes.astype("<u4").tobytes()),
        np.array([[len(w), c] for w, c in zip(words, sums)], "<u4").tobytes(), states.astype("<u8").tobytes(), places.astype("<u4").tobytes(),
        np.concatenate(words).astype("<u4").tobytes(),
    ]
    head = json.dumps({"tokens": len(ids), "bits": BITS, "block": BLOCK, "lanes": LANES, "every": EVERY, "table": table, "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *parts])


def unpack(coder: Coder, data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, sizes, ids) of a file; a wrong checksum is an error."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n = int.from_bytes(data[8:12], "little")
    head, parts, at = json.loads(data[12 : 12 + n]), [], 12 + n
    if (head["bits"], head["block"], head["lanes"], head["every"]) != (BITS, BLOCK, LANES, EVERY):
        raise ValueError("a token file of another layout")
    for size in head["parts"]:
        parts.append(data[at : at + size])
        at += size
    doc_ids, sizes = json.loads(zlib.decompress(parts[0])), np.frombuffer(zlib.decompress(parts[1]), "<u4").astype(np.int64)
    directory = np.frombuffer(parts[2], "<u4").reshape(-1, 2).astype(np.int64)
    n_blocks, per, k = len(directory), EVERY // LANES, BLOCK // EVERY
    states = np.frombuffer(parts[3], "<u8").reshape(n_blocks * k, LANES).astype(np.uint64)
    places = np.frombuffer(parts[4], "<u4").reshape(n_blocks, k).astype(np.int64)
    words = np.frombuffer(parts[5], "<u4")
    first = np.concatenate(([0], np.cumsum(directory[:, 0])[:-1]))
    used = np.minimum(np.maximum(head["tokens"] - np.arange(n_blocks) * BLOCK, 1), BLOCK)
    turns = np.clip(-(-used // LANES)[:, None] - np.arange(k) * per, 0, per)
    grid = coder.decode(words, (places + first[:, None]).ravel(), states, turns.ravel())
    full = np.zeros((n_blocks * k, per, LANES), np.uint32)
    full[:, : grid.shape[1]] = grid
    ids = full.reshape(-1)[: head["tokens"]]
    for b in range(n_blocks):
        if head["tokens"] and zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != directory[b, 1]:
            raise ValueError(f"block {b} is damaged")
    return doc_ids, sizes, ids


def _counted(n: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, np.int64)
        for b in batches:
            for ids in common.joined(b.column("ids")):
                counts += np.bincount(np.frombuffer(ids, kind), minlength=n)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["id", "n"])

    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over one range in order: adds the ids that come before each document in its range."""
    at = 0
    for b in batches:
        n = b.column("n").to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - n, pa.int64())], names=[*b.schema.names, "before"])
        at = int(ends[-1]) if len(ends) else at


def _written(frequencies, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, before, docs, ids, size = Coder(frequencies.value), None, 0, [], [], 0

        def flush():
            sizes = np.array([len(x) for x in ids], np.int64)
            data = pack(coder, docs, sizes, np.concatenate(ids), "frequencies")
            values = (f"tokens-{shard:08d}-{before:016d}.ans", shard, before, docs[0], len(docs), int(sizes.sum()), len(data), data)
            kinds = (pa.string(), *[pa.int64()] * 6, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], names=["file", "shard", "before", "first_doc_id", "n_docs", "n_tokens", "n_bytes", "data"])

        for b in batches:
            for s, p, d, x in zip(b.column("shard").to_pylist(), b.column("before").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids")):
                if docs and (s != shard or size >= FILE_TOKENS):
                    yield flush()
                    docs, ids, size = [], [], 0
                if not docs:
                    shard, before = s, p
                docs.append(d)
                ids.append(np.frombuffer(x.as_buffer(), kind))
                size += len(ids[-1])
        if docs:
            yield flush()

    return common.frugal(run)


MANIFEST = "file string, shard long, before long, first_doc_id long, n_docs long, n_tokens long, n_bytes long, data binary"


def write(documents: DataFrame, path: str, scratch: common.Scratch) -> tuple[DataFrame, np.ndarray]:
    """Encodes and writes all texts in ascending doc_id order. (table of the files, frequency table).

    shard is the range of doc_ids that a file belongs to, before the ids that come before it in that range.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = common.row_key(documents).withColumns({"_near": F.substring(text, 1, TIE_CHARS), "_hash": F.xxhash64(text), "_row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), F.asc("_near"), F.asc("_hash")]
    ordered = rows.repartitionByRange(*order, F.asc("_row")).sortWithinPartitions(*order).drop("_near", "_hash", "_row")
    n = max(bpe.worker_bytes(path)) + 1
    kind = "<u2" if n <= 1 << 16 else "<u4"
    ids = bpe.encode(ordered.withColumn("shard", F.spark_partition_id().cast("long")), path, library=True, kind=kind, end=END_ID)
    sized = ids.withColumn("n", F.length("ids").cast("long") / F.lit(np.dtype(kind).itemsize)).withColumn("n", F.col("n").cast("long"))
    held = scratch.write(sized.mapInArrow(_starts, "doc_id long, shard long, ids binary, n long, before long"), "ids")
    counts = np.zeros(n, np.int64)
    for i, c in held.select("ids").mapInArrow(_counted(n, kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[i] = c
    f = quantised(counts)
    shared = spark.sparkContext.broadcast(f)
    files = scratch.write(held.select("doc_id", "shard", "ids", "before").mapInArrow(_written(shared, kind), MANIFEST), "files", codec="none", large=True)
    scratch.write(spark.createDataFrame([(f.astype("<u4").tobytes(),)], "frequencies binary"), "frequencies")
    scratch.drop("ids")
    return files, f


def read(files: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, with the end id) from the files, wherever they lie.

    A range's start is the sum of those before it. There is a row of 16 bytes for each range, of which there are at most as
    many as shuffle partitions: they are broadcast up to ``MOST_RANGES``, and joined by a shuffle beyond.
    """
    spark = files.sparkSession
    ranges = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = ranges.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "base")
    shared = spark.sparkContext.broadcast(frequencies)

    def run(batches):
        coder = Coder(shared.value)
        for b in batches:
            for shard, before, data in zip(b.column("shard").to_pylist(), b.column("before").to_pylist(), b.column("data")):
                docs, n, ids = unpack(coder, data.as_buffer().to_pybytes())
                ends = before + np.cumsum(n)
                for a in range(0, len(docs), 500):
                    k = range(a, min(a + 500, len(docs)))
                    columns = ([docs[i] for i in k], [shard] * len(k), [int(ends[i] - n[i]) for i in k], [ids[ends[i] - n[i] - before : ends[i] - before].astype("<u4").tobytes() for i in k])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "shard", "before", "ids"])

    if int(spark.conf.get("spark.sql.shuffle.partitions")) <= MOST_RANGES:
        base = F.broadcast(base)
    found = files.select("shard", "before", "data").mapInArrow(common.frugal(run), "doc_id long, shard long, before long, ids binary")
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "ans")
    files, f = write(common.table(spark, sf_dir, "documents"), bpe.tokenizer_path(), scratch)
    back = read(files, f)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
