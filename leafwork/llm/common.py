"""Shared pieces of the training-data operators: scratch tables, batching, word and shingle hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; arrays of eight bytes for each of them are made.
STEP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts: rows by count and, where Spark has it, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. One of our own only on a local master: a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="leafwork-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/leafwork-{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def write(self, df: DataFrame, name: str, codec: str = "zstd", large: bool = False) -> DataFrame:
        """large: values of megabytes, for which row groups are kept small in memory and no dictionary is tried."""
        to = f"{self.path}/{name}"
        more = {"parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"} if large else {}
        df.write.options(compression=codec, **more).parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _at_exit(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.path)
        except Exception:  # the session is gone already, and its folder with it or left to the cluster
            pass


def running(df: DataFrame, order: str, value: str, name: str, scratch: Scratch) -> DataFrame:
    """Adds the exclusive prefix sum of a column in the order of another, whose values are distinct.

    Two levels: ranges of the order, each summed by its own task, and then the ranges, of which there are as many as tasks.
    """
    before = Window.unboundedPreceding, -1
    ranged = scratch.write(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), f"ranged-{name}")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_n"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(*before)), F.lit(0))).select("_range", "_base")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(*before)), F.lit(0))
    return ranged.withColumn("_own", own).join(base, "_range").withColumn(name, F.col("_base") + F.col("_own")).drop("_range", "_base", "_own")


def steps(texts: list[bytes] | list[str], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


# Words: A-Z lower-cased; runs of digits, letters a-z and bytes of non-ASCII characters.
_KEEP = np.zeros(256, np.uint8)
_KEEP[:] = 32
_KEEP[0x30:0x3A] = np.arange(0x30, 0x3A)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x41:0x5B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)
WORD_BYTES = _KEEP.tobytes()


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(64)]
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False, half: bool = False) -> np.ndarray:
    if half:
        if len(_powers.get("h", ())) < n:
            made = powers(n).astype(np.uint32)
            if n > 4 * STEP_BYTES:
                return made
            _powers["h"] = powers(max(n, STEP_BYTES)).astype(np.uint32)
        return _powers["h"][:n]
    key = "i" if inverse else "p"
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 1 << 16)
        x = np.full(size, _INVERSE if inverse else _P, np.uint64)
        x[0] = 1
        made = np.multiply.accumulate(x)
        if n > 4 * STEP_BYTES:  # for one very long text; not worth keeping
            return made[:n]
        _powers[key] = made
    return _powers[key][:n]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by prefix sums of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > 2 * STEP_BYTES and len(starts) > 1:  # in parts, for the sake of memory
        out, a = [], 0
        while a < len(starts):
            z = max(a + 1, int(np.searchsorted(starts, starts[a] + STEP_BYTES)))
            lo, hi = int(starts[a]), int(ends[z - 1])
            out.append(span_hash(data[lo:hi], starts[a:z] - lo, ends[a:z] - lo))
            a = z
        return np.concatenate(out)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(len(data), True)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, word starts, word ends, first word of each text and of the end)."""
    data = np.frombuffer(b" ".join(texts).translate(WORD_BYTES), np.uint8)
    edge = np.diff(np.concatenate(([0], (data != 32).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return data, starts, ends, np.searchsorted(starts, offsets)


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text: runs of ``width`` words. A text with fewer words, but not none, has one shingle of all of them."""
    data, starts, ends, first = word_spans(texts)
    h = span_hash(data, starts, ends)
    out = []
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += h[k : k + n] * _M[k]
    rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = sum(int(x) * int(_M[k + width]) for k, x in enumerate(h[a:b])) + int(b - a)
            out.append(mix(np.array([short % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def by_batch(f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> Callable:
    """For mapInArrow: f makes the output batches of each input batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return frugal(run)


def frugal(run: Callable) -> Callable:
    """For functions over a partition: memory that they have freed goes back to the system when they end.

    Spark keeps Python workers for later tasks, and the allocators would keep their largest size along with them.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of a binary column's values one behind another, without a copy."""
    if len(column):
        _, offsets, data = column.buffers()
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1]
        yield memoryview(data)[int(at[0]) : int(at[-1])]


def row_key(df: DataFrame) -> DataFrame:
    """doc_id as a long and text as a string, whatever other columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
