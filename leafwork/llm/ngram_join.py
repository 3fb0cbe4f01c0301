"""N-gram Jaccard join: Bayesian candidate pruning over MinHash values, then exact verification.

Texts are sets of shingles of five words. Two different texts are linked if their sets' Jaccard similarity is at least 0.8.

1. Every text gets 112 MinHash values of 16 bits; four values in a row make a band key, 28 keys in all. Exact copies fold
   into one unit. Two texts at 0.8 share no key with a probability of (1 - 0.8**4)**28 < 4e-7, more similar ones with less.
2. Units that share a key are compared value by value, 16 at a time. With m of n values equal and a uniform prior, the
   similarity's posterior is Beta(m + 1, n - m + 1); a pair is dropped once the posterior probability of 0.8 or more is
   below ``TOLERANCE``. What is left connects units to groups. Units of a bucket that are connected already are not compared
   again, so a bucket of many copies costs about as much as its size.
3. Within a group, all pairs are compared that way again, and what is left is verified exactly on the shingle sets, by
   products of incidence matrices. A task counts each unit's links and gives edges to one root for each component, never
   the pairs, so its output is at most one row for a unit. Large buckets and groups are split into blocks; pairs of blocks
   are tasks.
4. Connected components of the verified edges are the classes.

Texts with fewer than five words, but some, have one shingle of all of them. Null texts and texts without words are linked
to nothing. Repeated rows are exact copies. Rows with a null doc_id get null results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH = 5
#: The threshold as a fraction of whole numbers, so that verification has no rounding.
TOP, BOTTOM = 4, 5
BANDS, ROWS = 28, 4
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-7
#: Units of one block of a large bucket or group, and bytes of their shingle sets.
BLOCK, BLOCK_BYTES = 512, 32 << 20

_A = common.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[text, band] of 64-bit band keys, four MinHash values of 16 bits each; zeros for empty sets."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        first = np.concatenate(([0], np.cumsum([len(sets[i]) for i in some])[:-1]))
        for k, a in enumerate(_A):
            least = np.minimum.reduceat(flat * a, first)
            out[some, k] = (common.mix(least) >> np.uint64(48)).astype(np.uint16)
    return out.view(np.int64)


def least_matches() -> dict[int, int]:
    """For n values compared: how many must be equal lest the pair be dropped."""
    t, out = TOP / BOTTOM, {}
    for n in range(STEP, VALUES + 1, STEP):
        tail = np.cumsum([comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(n + 1)])
        out[n] = int(np.searchsorted(tail, TOLERANCE))
    return out


_LEAST = least_matches()


def alive(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of rows stay, comparing MinHash values incrementally."""
    at, equal = np.arange(len(i)), np.zeros(len(i), np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        equal += (values[i, n - STEP : n] == values[j, n - STEP : n]).sum(axis=1)
        keep = equal >= _LEAST[n]
        if not keep.all():
            at, equal, i, j = at[keep], equal[keep], i[keep], j[keep]
            if not len(at):
                break
    return at


def connect(values: np.ndarray) -> np.ndarray:
    """The component (its first row) of each row, where rows are joined that stay under ``alive``.

    Rows in one component already are not compared.
    """
    root = np.arange(len(values))
    for p in range(len(values) - 1):
        rest = np.flatnonzero(root[p + 1 :] != root[p]) + p + 1
        if len(rest):
            same = np.unique(root[rest[alive(values, np.full(len(rest), p), rest)]])
            if len(same):
                to = min(root[p], same[0])
                root[np.isin(root, same) | (root == root[p])] = to
    return root


def shared(sets: list[np.ndarray], at_once: int = 1 << 20) -> np.ndarray:
    """[row, row] of the sizes of intersections, exactly, for about ``at_once`` shingles of a range of values at a time."""
    n, wide = len(sets), 4096
    out = np.zeros((n, n), np.float32)
    parts = max(1, -(-sum(map(len, sets)) // at_once))
    cuts = [np.searchsorted(s, np.array([k * (1 << 64) // parts for k in range(1, parts)], np.uint64)) for s in sets]
    for k in range(parts):
        own = [s[(c[k - 1] if k else 0) : (c[k] if k < parts - 1 else len(s))] for s, c in zip(sets, cuts)]
        owner = np.repeat(np.arange(n), [len(s) for s in own])
        _, column, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        often = counts > 1
        number = np.cumsum(often) - 1
        keep = often[column]
        owner, column = owner[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for a in range(0, int(often.sum()), wide):
            lo, hi = np.searchsorted(column, [a, a + wide])
            x = np.zeros((n, min(wide, int(often.sum()) - a)), np.float32)
            x[owner[lo:hi], column[lo:hi] - a] = 1
            out += x @ x.T
    return out.astype(np.int64)


def links(values: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None) -> np.ndarray:
    """[row, row] of verified links; with sides, only between rows of different sides."""
    n = len(sets)
    i, j = np.triu_indices(n, 1)
    if side is not None:
        across = side[i] != side[j]
        i, j = i[across], j[across]
    kept = np.concatenate([a + alive(values, i[a : a + 100_000], j[a : a + 100_000]) for a in range(0, len(i), 100_000)]) if len(i) else np.zeros(0, np.int64)
    out = np.zeros((n, n), bool)
    if len(kept):
        i, j = i[kept], j[kept]
        size, inter = np.array([len(s) for s in sets]), shared(sets)[i, j]
        ok = inter * (TOP + BOTTOM) >= TOP * (size[i] + size[j])
        out[i[ok], j[ok]] = out[j[ok], i[ok]] = True
    return out


def spread(linked: np.ndarray) -> np.ndarray:
    """The component (its first row) of each row of an adjacency matrix."""
    root = np.arange(len(linked))
    i, j = np.nonzero(linked)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        root = root[root]
        if (root == before).all():
            return root


def grouped(keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow over rows sorted by keys: work on the rows of each key. A group is a block or two, so it is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            k = np.stack([b.column(x).to_numpy() for x in keys], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(k)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z > a:
                    if held and now != tuple(k[a]):
                        yield from work(pa.Table.from_batches(held))
                        held = []
                    now = tuple(k[a])
                    held.append(b.slice(a, z - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return common.frugal(run)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """[row, value] from a column of binary signatures."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), VALUES)


def _connect_buckets(t: pa.Table) -> Iterator[pa.RecordBatch]:
    if len(t) < 2:
        return
    units = t.column("unit").to_numpy()
    root = connect(_matrix(t.column("sig")))
    at = np.flatnonzero(root != np.arange(len(root)))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(units[at]), pa.array(units[root[at]])], names=["a", "b"])


def _verify_groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
    units, first = np.unique(t.column("unit").to_numpy(), return_index=True)
    if len(units) < 2:
        return
    t = t.take(pa.array(first))
    sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
    side = t.column("side").to_numpy()
    linked = links(_matrix(t.column("sig")), sets, side if t.column("block_a")[0] != t.column("block_b")[0] else None)
    n, root = linked.sum(axis=1), spread(linked)
    at = np.flatnonzero(n)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(units[at]), pa.array(units[root[at]]), pa.array(n[at], pa.int64())], names=["unit", "root", "n_links"])


def _signed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = common.encoded(batch.column("text"))
    sigs, sizes = [], []
    for a, z in common.steps(texts):
        sets = common.shingles(texts[a:z], WIDTH)
        sigs += [x.tobytes() for x in signatures(sets)]
        sizes += map(len, sets)
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], names=["doc_id", "digest", "n_shingles", "sig"])


def _shingled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts, sets = common.encoded(batch.column("text")), []
    for a, z in common.steps(texts):
        sets += [x.tobytes() for x in common.shingles(texts[a:z], WIDTH)]
    yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(sets, pa.binary())], names=["unit", "shingles"])


def _blocks(df: DataFrame, size: str, block: int, weight: F.Column | None = None) -> DataFrame:
    """Rows of a group of ``size`` (and weight in bytes) for each pair of its blocks: block_a <= block_b, side 1 for rows of the second of two."""
    n = F.ceil(F.greatest(F.col(size) / F.lit(block), (F.lit(0) if weight is None else weight) / F.lit(BLOCK_BYTES))).cast("int")
    df = df.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64("unit"), F.col("_n")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return df.withColumns({"block_a": F.least("_own", "_other"), "block_b": F.greatest("_own", "_other"), "side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_n", "_own", "_other", size)


def digest(column: str = "text") -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def join(documents: DataFrame, scratch: common.Scratch | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, class_id (least doc_id of its class), n_links (different texts it is linked to), n_copies (documents with its very text), digest."""
    spark = documents.sparkSession
    scratch = scratch or common.Scratch(spark, "ngram")
    docs = common.row_key(documents)
    known = docs.filter("doc_id is not null").withColumn("digest", digest())
    signed = known.mapInArrow(common.by_batch(_signed), "doc_id long, digest binary, n_shingles int, sig binary")
    rows = scratch.write(signed.withColumn("rid", F.monotonically_increasing_id()), "signatures")
    one = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("rid", "doc_id", "sig", "n_shingles")).alias("x"), F.count(F.lit(1)).alias("n_copies"))
    units = scratch.write(one.select("digest", F.col("x.rid").alias("unit"), F.col("x.doc_id").alias("doc_id"), F.col("x.sig").alias("sig"), F.col("x.n_shingles").alias("n_shingles"), "n_copies"), "units")

    # Units that share a band key, with their signatures; most units share none.
    bands = units.select("unit", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * 8 + 1, 8)))")).alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared_keys = bands.join(buckets, ["band", "key"]).join(units.select("unit", "sig"), "unit")
    by = ["band", "key", "block_a", "block_b"]
    tasks = _blocks(shared_keys, "n", block).select(*by, "unit", "sig").repartition(*by).sortWithinPartitions(*by)
    near = scratch.write(tasks.mapInArrow(grouped(by, _connect_buckets), "a long, b long").distinct(), "near")
    groups = scratch.write(components(near, scratch, "groups"), "members")

    # Groups with exact shingle sets.
    # Tables that are joined on a group's or class's key are written first: a large one is then a skew that Spark splits.
    weighed = groups.join(units.select(F.col("unit").alias("id"), "n_shingles"), "id")
    sizes = scratch.write(weighed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), (8 * F.sum(F.col("n_shingles").cast("long"))).alias("bytes")), "sizes")
    sized = groups.join(sizes, "root").withColumnRenamed("id", "unit").withColumnRenamed("root", "grp")
    mine = units.select("unit", "doc_id", "digest", "sig").join(sized, "unit")
    texts = docs.join(mine.select("unit", "doc_id", "digest"), "doc_id").filter(digest() == F.col("digest")).select("unit", "text")
    sets = texts.mapInArrow(common.by_batch(_shingled), "unit long, shingles binary")
    by = ["grp", "block_a", "block_b"]
    whole = mine.select("unit", "sig", "grp", "n", "bytes").join(sets, "unit")
    tasks = _blocks(whole, "n", block, F.col("bytes")).select(*by, "side", "unit", "sig", "shingles").repartition(*by).sortWithinPartitions(*by)
    verified = scratch.write(tasks.mapInArrow(grouped(by, _verify_groups), "unit long, root long, n_links long"), "verified")
    classes = components(verified.select(F.col("unit").alias("a"), F.col("root").alias("b")), scratch, "classes")
    counts = verified.groupBy("unit").agg(F.sum("n_links").alias("n_links"))
    per_unit = units.select("unit", "digest", "n_copies").join(classes.withColumnRenamed("id", "unit"), "unit", "left").join(counts, "unit", "left")
    per_unit = scratch.write(per_unit.select("digest", "n_copies", F.coalesce("root", "unit").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")

    member = rows.select("doc_id", "digest", "n_shingles").join(per_unit, "digest", "left")
    named = per_unit.join(rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("d")), "digest").groupBy("root").agg(F.min("d").alias("class_id"))
    named = scratch.write(named, "named")
    out = member.join(named, "root", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "digest")
    void = docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("n_copies"), digest().alias("digest"))
    done = scratch.write(out.unionByName(void), "done")
    scratch.drop("signatures", "units", "near", "members", "sizes", "verified", "classes", "named")
    return done


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents but for all of each class except the one with the least doc_id. Rows without doc_id come last, by a hash of
    their text; those of them without words all stay."""
    wordless = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")
    named = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1)))
    own = documents.filter(~wordless).withColumns({"_own_id": named, "_own_digest": digest()})
    done = join(own.select(F.col("_own_id").alias("doc_id"), "text"))
    stay = done.filter("doc_id = class_id").select(F.col("doc_id").alias("_key_id"), F.col("digest").alias("_key_digest")).distinct()
    kept = own.join(stay, (own["_own_id"] == stay["_key_id"]) & (own["_own_digest"] == stay["_key_digest"]), "left_semi").dropDuplicates(["_own_id", "text"])
    return kept.drop("_own_id", "_own_digest").unionByName(documents.filter(wordless))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
