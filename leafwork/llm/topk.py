"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors become integer term weights (a dimension is a term, zero weights are absent). Rows that repeat id and vector are
dropped first; the others are dealt to blocks by a hash of id and vector, and each block is packed into one row (ids and a
matrix) of a table in the shared folder. A task holds the postings of one candidate block, as many as ``HELD_BYTES`` allow, and
the packed query blocks stream past: for each term, the weights of the query rows that have it are multiplied by the term's
posting list and scattered into dense score arrays, for ``SLICE`` candidates at a time. Partition selection keeps the best k
of each query, and the blocks' lists are merged. So candidates move twice, however many queries there are, and queries once
for each candidate block; the products, all of them, are what costs.

A row's own id is no candidate for it. Ties go to the smaller id. Rows whose id is null or whose vector is null or
has null or non-finite components take no part; a shorter vector has zeros for what it lacks, an empty one nothing but zeros.
Of different vectors under one id each is a candidate, and their queries' lists are merged under that id. An empty table on
either side gives an empty one. Other columns, whatever their names, are left out. Weights beyond 64 bits are the nearest
64-bit integer, and sums beyond 64 bits wrap, as they do in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 5
SCALE = 256.0
EVERY = 50
QUERY_BLOCK = 512
#: Bytes of the weights of a candidate block, and candidates that are scored at once.
HELD_BYTES = 64 << 20
SLICE = 8192


def weights(df: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id and the integer weights floor(scale * x) of rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return df.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("long")).alias("w"))


def score_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the best k candidates of each query; candidates in the order of their ids."""
    scores = np.zeros((len(q_ids), len(c_ids)), np.int64)
    for term in range(min(q.shape[1], c.shape[1])):
        rows, postings = np.flatnonzero(q[:, term]), np.flatnonzero(c[:, term])
        if not len(rows) or not len(postings):
            continue
        add = np.multiply.outer(q[rows, term], c[postings, term])
        if len(rows) == len(q_ids) and len(postings) == len(c_ids):
            scores += add
        else:
            scores[np.ix_(rows, postings)] += add
    allowed = q_ids[:, None] != c_ids[None, :]
    scores[~allowed] = np.iinfo(np.int64).min
    n = min(k, len(c_ids))
    kth = np.partition(scores, len(c_ids) - n, axis=1)[:, len(c_ids) - n]
    out_q, out_c, out_s = [], [], []
    for i, least in enumerate(kth):
        row = scores[i]
        above = np.flatnonzero((row > least) & allowed[i])
        level = np.flatnonzero((row == least) & allowed[i])[: n - len(above)]  # ids ascend, so the smallest come first
        at = np.concatenate((above, level))
        out_q.append(np.full(len(at), q_ids[i]))
        out_c.append(c_ids[at])
        out_s.append(row[at])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query of several lists; equal entries count once."""
    q, c, s = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    if not len(q):
        return q, c, s
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])))
    q, c, s = q[new], c[new], s[new]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    best = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[best], c[best], s[best]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows sorted by block: one row for each run of a block's rows, its weights as a matrix."""

    def packed(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([x.column("vec_id").to_numpy() for x in parts])
        lists = [x.column("w") for x in parts]
        sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
        values = np.concatenate([x.flatten().to_numpy() for x in lists])
        width = int(sizes.max(initial=0))
        m = np.zeros((len(ids), width), np.int64)
        m[np.arange(width) < sizes[:, None]] = values
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([m[order].tobytes()], pa.binary())], names=["block", "n", "ids", "m"])

    held, now, size = [], None, 0
    for b in batches:
        keys = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if z > a:
                if held and (now != keys[a] or size >= HELD_BYTES):
                    yield packed(now, held)
                    held, size = [], 0
                now = int(keys[a])
                held.append(b.slice(a, z - a))
                size += held[-1].nbytes
    if held:
        yield packed(now, held)


def _unpacked(ids: bytes, m: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(m, np.int64).reshape(n, -1)


def _score(k: int):
    """For mapInArrow over packed rows sorted by candidate block, the candidates first: a list for each query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for cb, is_query, n, ids, m in zip(*(b.column(x) for x in ("cb", "is_query", "n", "ids", "m"))):
                if cb.as_py() != now:
                    now, held = cb.as_py(), []
                x = _unpacked(ids.as_py(), m.as_py(), n.as_py())
                if not is_query.as_py():
                    held.append(x)
                    continue
                lists = [score_block(*x, c_ids[a : a + SLICE], c[a : a + SLICE], k) for c_ids, c in held for a in range(0, len(c_ids), SLICE)]
                if lists:
                    yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in (merged(lists, k) if len(lists) > 1 else lists[0])], names=["query_id", "vec_id", "score"])

    return common.frugal(run)


def _blocks(rows: DataFrame, n: int, scratch: common.Scratch, name: str) -> DataFrame:
    own = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "w"), F.lit(n)).cast("int"))
    return scratch.write(own.repartition("block").sortWithinPartitions("block").select("block", "vec_id", "w").mapInArrow(common.frugal(_pack), "block int, n int, ids binary, m binary"), name)


def search(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the best k candidates of each query, all of them scored. Both have vec_id and w."""
    scratch = common.Scratch(queries.sparkSession, "topk")
    queries, candidates = (x.select("vec_id", "w").dropDuplicates() for x in (queries, candidates))
    n_q = queries.count()
    n_c, width = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("w")), F.lit(0))).first()
    most = max(1, HELD_BYTES // (8 * max(1, width)))
    candidate_block = candidate_block or min(most, max(256, n_c // 64))
    nq, nc = max(1, -(-n_q // query_block)), max(1, -(-n_c // candidate_block))
    q = _blocks(queries, nq, scratch, "queries").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).withColumn("is_query", F.lit(True))
    c = _blocks(candidates, nc, scratch, "candidates").withColumn("cb", F.col("block")).withColumn("is_query", F.lit(False))
    both = q.unionByName(c).repartition(min(nc, 1 << 16), "cb").sortWithinPartitions("cb", "is_query", "block")
    best = scratch.write(both.select("cb", "is_query", "n", "ids", "m").mapInArrow(_score(k), "query_id long, vec_id long, score long"), "best")
    scratch.drop("queries", "candidates")
    # Equal entries come from one vector under several query rows of an id; they count once.
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.repartition("query_id").distinct().withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = weights(common.table(spark, sf_dir, "embeddings"))
    return search(vectors.filter(F.col("vec_id") % EVERY == 0), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
