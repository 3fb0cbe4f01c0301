"""Substring dedup: content-defined chunking with a gear rolling hash, and a digest for each chunk.

1. A chunk ends before the word whose gear hash, that of the 8 bytes before it, is the least of some ``NEAR`` successive words,
   the last of equals: what ends a chunk depends only on the words around, so chunks of a passage are the same wherever it
   stands, and insertions shift nothing. Any ``NEAR`` words hold an end, whatever their bytes: a passage loses fewer than ``NEAR``
   words and the words of 8 bytes (``MARGIN`` in all) at its start, and fewer than ``NEAR`` at its end. ``PASSAGE`` words, be
   they of one letter, so keep ``MIN_WORDS`` in whole chunks. Chunks average about six words.
2. Digests that occur more than once are found by counting (pre-aggregated in each task, so one common passage is one row of
   each). A run of repeated chunks with ``MIN_WORDS`` words or more is a candidate, with ``MARGIN`` words on both sides of it;
   most documents have none.
3. Candidates are checked exactly: windows of ``LEAST`` words are counted in the same way, by 64-bit hashes. Of any ``SPREAD``
   successive windows at least that of the least hash is among them, so equal passages show equal windows, and a passage of
   ``PASSAGE`` words or more shows one. Words that lie in a window that occurs more than once are repeated passages. So every
   repeated passage of ``PASSAGE`` words is found, but for fewer than ``SPREAD`` words at each of its ends, and none of less
   than ``LEAST``. Both are a little below the 50 words looked for, as the words at a passage's ends may be joined to others.

The occurrence of a window that is kept is that of the least doc_id, and the first in that document; words of later ones are
cut, with the white space behind them.

Null and empty texts have no chunks. Rows that repeat both doc_id and text count as one document: each gets the same result,
and nothing of it counts as repeated on their account. Documents of different texts under one id follow each other by a hash
of the text. Rows with a null doc_id count as the last documents, among each other by that hash too. An empty table gives an
empty one. Other columns, whatever their names, are left alone, but for n_chars, which follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
NEAR = 13
PASSAGE, SPREAD = 48, 4
LEAST = PASSAGE - SPREAD + 1
MARGIN = 18
MIN_WORDS = PASSAGE - MARGIN - NEAR + 1

_GEAR = (common.mix(np.arange(256, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)
_GEAR[0] = 0
_LAST = (1 << 63) - 1


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte: the sum over the last 8 bytes b of GEAR[b] << distance, modulo 2**32, by doubling the window."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def _least(h: np.ndarray, group: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Positions of the last least hash of any ``near`` successive ones of a group."""
    key = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), 0, -1, dtype=np.uint64)
    width = 1
    while width < near:
        step = min(width, near - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    key = key[group[: len(key)] == group[len(group) - len(key) :]]
    return np.unique(len(h) - (key & np.uint64(0xFFFFFFFF)).astype(np.int64))


def chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: digests, and lengths in characters and in words of its chunks. A word belongs to the chunk it starts in."""
    gap = b"\0" * WINDOW
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    inner = (data & 0xC0) != 0x80  # first bytes of characters
    chars = np.concatenate(([0], np.cumsum(inner)))
    solid = data > 32
    begins = solid & ~np.concatenate(([False], solid[:-1]))
    words = np.concatenate(([0], np.cumsum(begins)))
    begins = np.flatnonzero(begins)
    sizes = np.array([len(t) + WINDOW for t in texts], np.int64)
    ends = begins[_least(gear(data)[begins - 1], np.searchsorted(np.cumsum(sizes) + WINDOW, begins, "right"))]
    at = WINDOW
    for t in texts:
        stop = at + len(t)
        if t:
            lo, hi = np.searchsorted(ends, [at, stop], "right")
            own = ends[lo:hi]
            own = own[own < stop]
            starts, stops = np.concatenate(([at], own)), np.concatenate((own, [stop]))
            yield common.span_hash(data[at:stop], starts - at, stops - at).view(np.int64), chars[stops] - chars[starts], words[stops] - words[starts]
        else:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = stop + WINDOW


def _chunked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = common.encoded(batch.column("text"))
    out: list[list] = [[], []]
    for a, z in common.steps(texts):
        for digests, _, words in chunks(texts[a:z]):
            out[0].append(digests)
            out[1].append(np.concatenate(([0], np.cumsum(words))) if len(words) else words)
    kinds = pa.list_(pa.int64()), pa.list_(pa.int32())
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "tid", "digests", "words"])


def runs(flags: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, end) of runs of flagged chunks with enough words."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    total = np.concatenate(([0], np.cumsum(words)))
    return [(a, z) for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)) if total[z] - total[a] >= least]


def _candidates(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of the places of each document's repeated chunks, the runs with enough words: ranges of words, with a margin."""
    rids, ranges = [], []
    for rid, marks in zip(batch.column("rid").to_pylist(), batch.column("marks")):
        place = np.sort(marks.values.to_numpy())
        first, end = place >> 31, place & ((1 << 31) - 1)
        cut = np.flatnonzero(np.concatenate(([True], first[1:] != end[:-1])))
        lo, hi = first[cut], end[np.append(cut[1:], len(end)) - 1]
        long_ = hi - lo >= MIN_WORDS
        if long_.any():
            rids.append(rid)
            ranges.append(np.stack([np.maximum(0, lo - MARGIN), hi + MARGIN], 1)[long_].ravel())
    yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(ranges, pa.list_(pa.int32()))], names=["rid", "ranges"])


def windows(text: bytes, ranges: list[int], size: int = LEAST) -> tuple[np.ndarray, ...]:
    """Of these ranges of words: words in each run of them; first characters of its words and of what follows; and of chosen
    windows of ``size`` words within a run, the first word (counted over all runs) and the hash."""
    data = np.frombuffer(text, np.uint8)
    solid = np.concatenate(([False], data > 32, [False]))
    starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(~solid[1:] & solid[:-1])
    wanted = np.zeros(len(starts) + 1, np.int32)
    for a, z in zip(ranges[::2], ranges[1::2]):
        wanted[min(a, len(starts))] += 1
        wanted[min(z, len(starts))] -= 1
    number = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
    if not len(number):
        return (np.zeros(0, np.int64),) * 4
    run = np.cumsum(np.diff(number, prepend=number[0]) > 1)
    sizes = np.bincount(run)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    last = np.cumsum(sizes)
    following = chars[np.append(starts, len(data))[number[last - 1] + 1]]
    bounds = np.insert(chars[starts[number]], last, following)
    h = common.span_hash(data, starts[number], ends[number])
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * common.powers(len(h)), dtype=np.uint64)))
    n = max(0, len(h) - size + 1)
    at = np.flatnonzero(run[size - 1 :] == run[:n])
    rolled = common.mix((prefix[at + size] - prefix[at]) * common.powers(len(h), True)[at])
    chosen = _least((rolled >> np.uint64(32)).astype(np.uint32), run[at], SPREAD)
    few = np.flatnonzero(np.bincount(run[at], minlength=len(sizes)) < SPREAD) if len(at) else []
    short = [int(own[np.argmin(rolled[own])]) for r in few if len(own := np.flatnonzero(run[at] == r))]
    chosen = np.union1d(chosen, np.array(short, np.int64)).astype(np.int64)
    return sizes, bounds, at[chosen], rolled[chosen].view(np.int64)


_WINDOWS = "own long, tid long, sizes array<int>, bounds array<int>, windows array<struct<at:int,hash:long>>"


def _windowed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out = [windows(t, r) for t, r in zip(common.encoded(batch.column("text")), batch.column("ranges").to_pylist())]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x[2]) for x in out]))), pa.int32())
    flat = [np.concatenate([x[k] for x in out]) for k in (2, 3)]
    found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int64())], names=["at", "hash"]))
    yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("tid"), *(pa.array([x[k] for x in out], pa.list_(pa.int32())) for k in (0, 1)), found], names=["own", "tid", "sizes", "bounds", "windows"])


_SPANS = "array<struct<start:int,end:int,words:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))


def _passages(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    found: list[list] = [[], []]
    for own, tid, sizes, bounds, marks in zip(*(batch.column(n) for n in ("own", "tid", "sizes", "bounds", "marks"))):
        own, tid = own.as_py(), tid.as_py()
        sizes, bounds = sizes.values.to_numpy(), bounds.values.to_numpy()
        behind_run = np.cumsum(sizes + 1) - 1
        start, behind = np.delete(bounds, behind_run), np.delete(bounds, behind_run - sizes)
        number = np.arange(len(start)) + np.repeat(np.arange(len(sizes)), sizes)
        m = marks.values
        names = [f.name for f in m.type]
        at, h, first = m.field("at").to_numpy(), m.field("hash").to_numpy(), m.field("first").to_numpy()
        later = np.ones(len(at), bool)
        order = np.argsort(at)
        later[order[np.unique(h[order], return_index=True)[1]]] = False  # each hash's first place in this text
        later |= own > first
        if "tie" in names:
            later |= np.array([t is not None and tid > t for t in m.field("tie").to_pylist()], bool)
        for column, places in zip(found, (at, at[later])):
            edge = np.zeros(len(start) + 1, np.int32)
            np.add.at(edge, places, 1)
            np.add.at(edge, places + LEAST, -1)
            covered = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            cut = np.flatnonzero(np.diff(number[covered], prepend=-2) > 1)
            last = np.append(cut[1:], len(covered)) - 1
            column.append([{"start": int(start[covered[a]]), "end": int(behind[covered[z]]), "words": int(z - a + 1)} for a, z in zip(cut, last)])
    yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("tid"), *(pa.array(c, _SPANS_ARROW) for c in found)], names=["own", "tid", "repeated", "cut"])


def find(documents: DataFrame, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, tid (a hash of the text), repeated and cut (spans in characters, with their words) of documents with a repeated passage."""
    scratch = scratch or common.Scratch(documents.sparkSession, "substring")
    docs = common.row_key(documents).withColumn("tid", F.xxhash64("text"))
    cut = docs.mapInArrow(common.by_batch(_chunked), "doc_id long, tid long, digests array<long>, words array<int>")
    own = F.coalesce("doc_id", F.lit(_LAST)).alias("own")
    rows = scratch.write(cut.select(own, "tid", "digests", "words", F.monotonically_increasing_id().alias("rid")), "chunks")
    # place: the words before a chunk, and those before the next; where one chunk ends its successor begins.
    each = rows.select("rid", "words", F.posexplode("digests").alias("at", "digest"))
    each = each.select("rid", "digest", F.shiftleft(F.col("words")[F.col("at")].cast("long"), 31).bitwiseOR(F.col("words")[F.col("at") + 1].cast("long")).alias("place"))
    # Rows repeated with id and text have equal (own, tid): only the first of them is looked at.
    again = rows.groupBy("own", "tid").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    twins = scratch.write(rows.select("own", "tid", "rid").join(again.select("own", "tid", F.col("rid").alias("head")), ["own", "tid"]).filter("rid <> head").select("rid"), "twins")
    repeats = not _empty(twins)
    if repeats:
        each = each.join(twins, "rid", "left_anti")
    # Written, so that a very common digest is a skew of a plain join, which Spark splits.
    twice = scratch.write(each.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "twice")
    marks = each.join(twice, "digest").groupBy("rid").agg(F.collect_list("place").alias("marks"))
    ranges = marks.mapInArrow(common.by_batch(_candidates), "rid long, ranges array<int>")
    ranges = scratch.write(ranges.join(rows.select("rid", "own", "tid"), "rid").drop("rid"), "ranges")
    several = scratch.write(rows.groupBy("own").agg(F.min("tid").alias("least"), F.max("tid").alias("most")).filter("least <> most").select("own"), "several")
    again = scratch.write(rows.select("own", "tid"), "rows") if repeats else None
    scratch.drop("chunks", "twins", "twice")

    # The texts of the candidates, and their windows.
    texts = docs.select(own, "tid", "text").join(ranges, ["own", "tid"])
    texts = texts.dropDuplicates(["own", "tid"]) if repeats else texts
    held = scratch.write(texts.mapInArrow(common.by_batch(_windowed), _WINDOWS).withColumn("wid", F.monotonically_increasing_id()), "windows")
    scratch.drop("ranges")
    each = held.select("wid", "own", "tid", F.inline("windows"))
    firsts = each.groupBy("hash").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "first")
    found, mark = each.drop("tid").join(scratch.write(firsts, "firsts"), "hash"), ["at", "hash", "first"]
    # Where several texts have one id, the least hash of those with a window is its first.
    if not _empty(several):
        ties = scratch.write(each.join(several, "own").groupBy("hash", "own").agg(F.min("tid").alias("tie")), "ties")
        found = found.join(ties.withColumnRenamed("own", "first"), ["hash", "first"], "left").withColumn("tie", F.when(F.col("own") == F.col("first"), F.col("tie")))
        mark.append("tie")
    marks = found.groupBy("wid").agg(F.collect_list(F.struct(*mark)).alias("marks"))
    passages = held.drop("windows").join(marks, "wid").mapInArrow(common.by_batch(_passages), f"own long, tid long, repeated {_SPANS}, cut {_SPANS}")
    if repeats:
        passages = again.join(scratch.write(passages, "passages"), ["own", "tid"])
    done = scratch.write(passages.select(F.when(F.col("own") != _LAST, F.col("own")).alias("doc_id"), "tid", "repeated", "cut"), "done")
    scratch.drop("several", "rows", "windows", "firsts", "ties", "passages")
    return done


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def without(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def cut_repeats(documents: DataFrame) -> DataFrame:
    """The documents with later occurrences of repeated passages cut out of text, and n_chars to match."""
    cuts = find(documents).filter(F.size("cut") > 0).select(F.col("doc_id").alias("_key_id"), F.col("tid").alias("_key_tid"), F.col("cut").alias("_cut_spans")).dropDuplicates(["_key_id", "_key_tid"])
    own = documents.withColumn("_own_tid", F.xxhash64(F.col("text").cast("string")))
    both = own.join(cuts, own["doc_id"].cast("long").eqNullSafe(cuts["_key_id"]) & (own["_own_tid"] == cuts["_key_tid"]), "left").drop("_key_id", "_key_tid", "_own_tid")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [without(t, c) if c and t else t for t, c in zip(batch.column("text").to_pylist(), batch.column("_cut_spans").to_pylist())]
        changed = {"text": pa.array(texts, pa.string())}
        names = [n for n in batch.schema.names if n != "_cut_spans"]
        yield pa.RecordBatch.from_arrays([changed.get(n, batch.column(n)) for n in names], names=names)

    out = both.mapInArrow(common.by_batch(run), documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with a repeated passage."""
    found = find(common.table(spark, sf_dir, "documents"))
    words = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["words"]).cast("long")
    return found.select("doc_id", F.size("repeated").cast("long").alias("n_passages"), words("repeated").alias("n_words"), F.size("cut").cast("long").alias("n_cut"), words("cut").alias("n_words_cut"), F.lit(True).alias("repeats"), "repeated", "cut")
