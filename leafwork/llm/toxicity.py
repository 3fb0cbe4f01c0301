"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is an embedding of the word and the mean of the embeddings of its character n-grams (3 to 5 bytes, with its
bounds), both hashed. Windows of ``WINDOW`` words overlap by half; all of them are scored, and a text's score is that of its
worst window. Inputs come from the text alone.

Training looks at a bounded sample of labelled documents: the first ``POSITIVE`` and ``NEGATIVE`` that exist, in the order of a
hash of their ids, never of the held-out fold, as far as ``SAMPLE_BYTES`` of text for each label reach. A text of any length
can be drawn; of one beyond ``LONG`` characters, ``STRETCHES`` stretches spread evenly over the whole of it are learnt from.
Labels are of whole texts, so the window that makes a text toxic is found in turns: where n-grams of toxic texts stand at
first, then where the network itself looks. The bias is set last, so that 0.5 separates the sample's texts best. One task of
an executor fits the network; the driver only passes its parameters (3 MB) on.

Null and empty texts, and texts without words, score 0. Repeated rows each get a row. Of different texts under one id, the
least is learnt from. Labels that are null, or contradict one another under one id, are not learnt from. Without texts of both
labels, all scores are 0. An empty table gives an empty one. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE = 32, 16
POSITIVE, NEGATIVE = 1200, 2000
#: Bytes of text that training looks at, for each label.
SAMPLE_BYTES = 6 << 20
LONG, STRETCHES = 120_000, 60
#: Labelled ids that are looked for among the documents first, for each that is wanted.
DRAW = 8
BUCKETS = 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 16, 12, 8
EPOCHS, BATCH, RATE = 6, 256, 0.01
GRAMS = (3, 4, 5)
#: Windows scored at once.
GROUP = 4096


class Words:
    """The words of some texts: which distinct word stands where, and each distinct word's hashed inputs."""

    def __init__(self, texts: list[bytes]):
        data, starts, ends, self.first = common.word_spans([b"", *texts, b""])
        self.first = self.first[1:-1]
        h = common.span_hash(data, starts, ends)
        _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        self.word = inverse.astype(np.int32)
        self.bucket = (h[at] >> np.uint64(49)).astype(np.int64)
        s, e = starts[at] - 1, ends[at] + 1
        grams, counts = [], []
        for n in GRAMS:
            size = np.maximum(0, e - s - n + 1)
            place = _ranges(s, size)
            rolled = np.zeros(len(place), np.uint64)
            for k in range(n):
                rolled += data[place + k].astype(np.uint64) * np.uint64(pow(0x9E3779B97F4A7C15, k + n, 1 << 64))
            grams.append((common.mix(rolled) >> np.uint64(49)).astype(np.int32))
            counts.append(size)
        # One list of n-grams for each word: those of 3 bytes, then 4, then 5.
        total = np.sum(counts, axis=0)
        self.gram_first = np.concatenate(([0], np.cumsum(total)))
        self.grams = np.zeros(self.gram_first[-1], np.int32)
        place = self.gram_first[:-1].copy()
        for g, size in zip(grams, counts):
            self.grams[_ranges(place, size)] = g
            place += size

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct words [window, place], -1 behind the end; text of each window). Texts without words have none."""
        n = np.diff(self.first)
        per = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), per)
        start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        place = start[:, None] * STRIDE + np.arange(WINDOW)
        inside = place < n[text][:, None]
        where = np.where(inside, place + self.first[:-1][text][:, None], 0)
        return np.where(inside, self.word[where] if len(self.word) else 0, -1).astype(np.int32), text


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] values, then those of the next."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 7):
        r, h = np.random.default_rng(seed), HIDDEN
        make = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        self.p = {
            "word": make(BUCKETS, WORD_DIM, by=0.05), "char": make(BUCKETS, CHAR_DIM, by=0.3), "wx": make(WORD_DIM + CHAR_DIM, 6 * h, by=0.3), "bx": np.zeros(6 * h, np.float32),
            "uf": make(h, 3 * h, by=0.3), "ub": make(h, 3 * h, by=0.3), "wa": make(2 * h, ATTENTION, by=0.3), "ba": np.zeros(ATTENTION, np.float32), "va": make(ATTENTION, by=0.3), "wo": make(2 * h, by=0.3), "bo": np.zeros(1, np.float32),
        }

    def inputs(self, w: Words, of: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Input vectors of the distinct words ``of`` (all by default)."""
        of = np.arange(len(w.bucket)) if of is None else of
        size = np.diff(w.gram_first)[of]
        grams = w.grams[_ranges(w.gram_first[:-1][of], size)]
        ends = np.cumsum(size)
        chars = np.zeros((len(of), CHAR_DIM), np.float32)
        for a in range(0, len(of), 16_384):  # n-grams of so many words at once
            n = size[a : a + 16_384]
            some = np.flatnonzero(n)
            if len(some):
                first = ends[a : a + 16_384] - n
                own = self.p["char"][grams[first[0] : first[-1] + n[-1]]]
                chars[a + some] = np.add.reduceat(own, (first - first[0])[some]) / n[some, None]
        return np.concatenate((self.p["word"][w.bucket[of]], chars), axis=1), (of, size, grams)

    def forward(self, projected: np.ndarray, places: np.ndarray, keep: bool = False):
        """Scores (logits) of windows. projected: [distinct word, 6 H], and a row of zeros at the end for places of -1."""
        p, n, h = self.p, len(places), HIDDEN
        live = places >= 0
        states = np.zeros((WINDOW, n, 2 * h), np.float32)
        kept = []
        for side, u in ((0, p["uf"]), (1, p["ub"])):
            x = np.ascontiguousarray(projected[:, side * 3 * h : (side + 1) * 3 * h])
            s = np.zeros((n, h), np.float32)
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                g, a = x[places[:, t]], s @ u
                zr = g[:, : 2 * h] + a[:, : 2 * h]
                np.negative(zr, out=zr)
                np.exp(np.minimum(zr, 30, out=zr), out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :h], zr[:, h:]
                c = r * a[:, 2 * h :]
                c += g[:, 2 * h :]
                np.tanh(c, out=c)
                new = c + z * (s - c)
                if not live[:, t].all():
                    new *= live[:, t, None]
                if keep:
                    kept.append((side, t, s, z, r, c, a[:, 2 * h :]))
                s = new
                states[t, :, side * h : (side + 1) * h] = s
        e = np.tanh(states @ p["wa"] + p["ba"])
        att = e @ p["va"]
        att[~live.T] = -1e9
        att = np.exp(att - att.max(axis=0))
        att /= att.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", att, states)
        logit = pooled @ p["wo"] + p["bo"][0]
        return (logit, (live, states, kept, e, att, pooled)) if keep else logit

    def gradients(self, w: Words, places: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        p, h, n = self.p, HIDDEN, len(places)
        used, back = np.unique(places, return_inverse=True)
        back = back.reshape(places.shape)
        if used[0] == -1:
            used, back = used[1:], back - 1
            back[back < 0] = len(used)
        x, (of, size, grams) = self.inputs(w, used)
        projected = np.concatenate((x @ p["wx"] + p["bx"], np.zeros((1, 6 * h), np.float32)))
        padded = np.where(places < 0, len(used), back)
        logit, (live, states, kept, e, att, pooled) = self.forward(projected, np.where(places < 0, -1, padded), True)
        prob = _sigmoid(logit)
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        d = ((prob - y) / n).astype(np.float32)
        g = {"wo": pooled.T @ d, "bo": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["wo"]
        datt = np.einsum("nh,tnh->tn", dpool, states)
        dstates = att[:, :, None] * dpool
        dscore = att * (datt - (att * datt).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", dscore, e)
        de = dscore[:, :, None] * p["va"] * (1 - e * e)
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", states, de), de.sum(axis=(0, 1))
        dstates += de @ p["wa"].T
        dgates = np.zeros((n, WINDOW, 6 * h), np.float32)
        g["uf"], g["ub"] = np.zeros_like(p["uf"]), np.zeros_like(p["ub"])
        carry = [np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)]
        for side, t, s, z, r, c, an in reversed(kept):
            u, name = (p["uf"], "uf") if side == 0 else (p["ub"], "ub")
            ds = (dstates[t, :, side * h : (side + 1) * h] + carry[side]) * live[:, t, None]
            dz = ds * (s - c) * z * (1 - z)
            dc = ds * (1 - z) * (1 - c * c)
            dr = dc * an * r * (1 - r)
            da = np.concatenate((dz, dr, dc * r), axis=1)
            dgates[:, t, side * 3 * h : (side + 1) * 3 * h] = np.concatenate((dz, dr, dc), axis=1)
            g[name] += s.T @ da
            carry[side] = ds * z + da @ u.T
        flat = padded.ravel()
        order = np.argsort(flat, kind="stable")
        heads = np.flatnonzero(np.diff(flat[order], prepend=-1))
        dproj = np.zeros((len(used) + 1, 6 * h), np.float32)
        dproj[flat[order[heads]]] = np.add.reduceat(dgates.reshape(-1, 6 * h)[order], heads)
        dproj = dproj[:-1]
        g["wx"], g["bx"] = x.T @ dproj, dproj.sum(axis=0)
        dx = dproj @ p["wx"].T
        g["word"] = (w.bucket[of], dx[:, :WORD_DIM])
        g["char"] = (grams, np.repeat(dx[:, WORD_DIM:] / np.maximum(size, 1)[:, None], size, axis=0))
        return loss, g

    def score(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, windows, text of each window)."""
        places, text = w.windows()
        x, _ = self.inputs(w)
        projected = np.concatenate((x @ self.p["wx"] + self.p["bx"], np.zeros((1, 6 * HIDDEN), np.float32)))
        parts = [self.forward(projected, places[a : a + GROUP]) for a in range(0, len(places), GROUP)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32), places, text


class Adam:
    def __init__(self, p: dict):
        self.p, self.m, self.v, self.k = p, {n: np.zeros_like(x) for n, x in p.items()}, {n: np.zeros_like(x) for n, x in p.items()}, 0

    def step(self, g: dict, rate: float) -> None:
        self.k += 1
        rate *= np.sqrt(1 - 0.999**self.k) / (1 - 0.9**self.k)
        for n, x in g.items():
            if isinstance(x, tuple):  # rows of an embedding
                order = np.argsort(x[0], kind="stable")
                heads = np.flatnonzero(np.diff(x[0][order], prepend=-1))
                rows, d = x[0][order[heads]], np.add.reduceat(x[1][order], heads)
            else:
                rows, d = slice(None), x
            m, v = self.m[n], self.v[n]
            m[rows] = 0.9 * m[rows] + 0.1 * d
            v[rows] = 0.999 * v[rows] + 0.001 * d * d
            self.p[n][rows] -= (rate * m[rows] / (np.sqrt(v[rows]) + 1e-8)).astype(np.float32)


def _suspects(w: Words, toxic: np.ndarray) -> np.ndarray:
    """For each distinct word: how much more often its n-grams stand in toxic texts, at most."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for k, y in enumerate(toxic):
        words = np.unique(w.word[w.first[k] : w.first[k + 1]])
        seen[int(y), np.unique(w.grams[_ranges(w.gram_first[:-1][words], np.diff(w.gram_first)[words])])] += 1
    odds = np.log((seen[1] + 0.5) / (toxic.sum() + 1)) - np.log((seen[0] + 0.5) / ((~toxic).sum() + 1))
    some = np.flatnonzero(np.diff(w.gram_first))
    out = np.full(len(w.bucket), -9.0)
    if len(some):
        out[some] = np.maximum.reduceat(odds[w.grams] * np.log1p(seen.sum(axis=0))[w.grams], w.gram_first[:-1][some])
    return out


def _best(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The window of the greatest value of each text, -1 for none."""
    order = np.lexsort((value, text))
    last = np.flatnonzero(np.append(np.diff(text[order]) != 0, True)) if len(order) else order
    out = np.full(n, -1)
    out[text[order[last]]] = order[last]
    return out


def _mixed(places: np.ndarray, toxic: np.ndarray, suspects: np.ndarray, other: np.ndarray, rng) -> np.ndarray:
    """Toxic windows with many of their unsuspicious words changed for those of clean windows, so that contexts aren't learnt by heart."""
    s = suspects[places]
    change = toxic[:, None] & (s < 0.7 * s.max(axis=1, keepdims=True)) & (places >= 0) & (other >= 0) & (rng.random(places.shape) < 0.7 * rng.random((len(places), 1)) + 0.3)
    return np.where(change, other, places)


def train(texts: list[bytes], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """None where there are not both labels."""
    if not toxic.any() or toxic.all():
        return None
    w, net, rng = Words(texts), Network(seed), np.random.default_rng(seed)
    places, text = w.windows()
    if not len(text):
        return None
    suspects = np.append(_suspects(w, toxic), -9.0)
    value = suspects[places].max(axis=1)
    adam = Adam(net.p)
    clean = np.flatnonzero(~toxic[text])
    for epoch in range(epochs):
        best = _best(value, text, len(texts))
        pos = best[toxic & (best >= 0)]
        hard = best[~toxic & (best >= 0)]
        if epoch == 0:
            hard = hard[:0]
        neg = np.concatenate((hard, rng.choice(clean, min(len(clean), max(len(pos), (~toxic).sum())), replace=False))) if len(clean) else hard
        # Small samples are gone over several times in an epoch.
        rounds = int(np.clip(4096 // max(1, len(pos) + len(neg)), 1, 8))
        for _ in range(rounds):
            pick = np.concatenate((np.repeat(pos, max(1, len(neg) // max(1, 2 * len(pos)))), neg))
            rng.shuffle(pick)
            for a in range(0, len(pick), BATCH):
                k = pick[a : a + BATCH]
                y = toxic[text[k]]
                _, g = net.gradients(w, _mixed(places[k], y, suspects, places[rng.choice(clean, len(k))], rng), y.astype(np.float32))
                adam.step(g, RATE * (1 - 0.85 * epoch / max(1, epochs - 1)))
        value = net.score(w)[0]
    best = _best(value, text, len(texts))
    has = np.flatnonzero(best >= 0)
    level, y = value[best[has]], toxic[has]
    order = np.argsort(level)
    level, y = level[order], y[order]
    # Cutting before place k leaves k texts below: wrong are toxic ones below and clean ones above.
    wrong = np.concatenate(([0], np.cumsum(y))) / max(1, y.sum()) + ((~y).sum() - np.concatenate(([0], np.cumsum(~y)))) / max(1, (~y).sum())
    at = np.flatnonzero(wrong == wrong.min())
    low, high = np.concatenate(([level[0] - 4], level)), np.concatenate((level, [level[-1] + 4]))
    k = at[np.argmax((high - low)[at])]
    net.p["bo"] -= np.float32((low[k] + high[k]) / 2)
    return net


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _drawn(documents: DataFrame, labels: DataFrame) -> list[tuple[int, int]]:
    """(doc_id, toxic) of the sample: at most POSITIVE + NEGATIVE ids of documents that exist."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").select("doc_id", "toxic", F.xxhash64("doc_id").alias("at"))
    present = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = []
    for label, n in ((1, POSITIVE), (0, NEGATIVE)):
        own = one.filter(F.col("toxic") == label)
        some = own.orderBy("at", "doc_id").limit(DRAW * n)  # so the broadcast and what comes back have a proven bound
        found = present.join(F.broadcast(some), "doc_id").select("at", "doc_id").distinct().orderBy("at", "doc_id").limit(n).collect()
        if len(found) < n and some.count() == DRAW * n:  # too many labels without a document: look for all of them
            found = own.join(present, "doc_id", "left_semi").orderBy("at", "doc_id").limit(n).select("at", "doc_id").collect()
        out += [(r["doc_id"], label) for r in found]
    return out


def _excerpt(text: F.Column) -> F.Column:
    """Texts of up to LONG characters, and stretches spread evenly over longer ones."""
    n, size = F.length(text), LONG // STRETCHES
    first = lambda k: (F.lit(1) + F.floor(k * (n - size) / F.lit(STRETCHES - 1))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substring(text, first(k), size))
    return F.when(n <= LONG, text).otherwise(F.array_join(parts, " "))


def sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the bounded sample that training looks at."""
    ids = documents.sparkSession.createDataFrame(_drawn(documents, labels), "doc_id long, toxic int")
    rows = common.row_key(documents).filter("text is not null").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", _excerpt(F.col("text")).alias("text"), "toxic")


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over the whole sample in a fixed order: one row, the parameters; none without both labels."""
    texts, toxic, size = [], [], [0, 0]
    for b in batches:
        for text, y in zip(common.encoded(b.column("text")), b.column("toxic").to_pylist()):
            if size[y] < SAMPLE_BYTES:
                size[y] += len(text)
                texts.append(text)
                toxic.append(y == 1)
    net = train(texts, np.array(toxic, bool)) if texts else None
    if net:
        out = BytesIO()
        np.savez(out, **net.p)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["parameters"])


def scores(documents: DataFrame, net: Network | None, keep: list[str], name: str = "score") -> DataFrame:
    """The columns keep (of text and others) and the score of each row, as column ``name``."""
    spark = documents.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(net.p if net else None)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = common.encoded(batch.column("text"))
        out = np.zeros(len(texts))
        if shared.value is not None:
            own = Network.__new__(Network)
            own.p = shared.value
            for a, z in common.steps(texts):
                logit, _, text = own.score(Words(texts[a:z]))
                if len(logit):
                    first = np.flatnonzero(np.concatenate(([True], np.diff(text) != 0)))
                    out[a + text[first]] = _sigmoid(np.maximum.reduceat(logit, first).astype(float))
        names = [n for n in batch.schema.names if n in keep]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.float64())], names=[*names, name])

    source = documents.select(*keep, *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))
    schema = source.select(*keep).withColumn(name, F.lit(None).cast("double")).schema
    return source.mapInArrow(common.by_batch(run), schema)


def fitted(documents: DataFrame, labels: DataFrame) -> Network | None:
    """The network, fitted by one task and written to the shared folder before it is used."""
    scratch = common.Scratch(documents.sparkSession, "toxicity")
    one = sample(documents, labels).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = scratch.write(one.select("text", "toxic").mapInArrow(common.frugal(_fit), "parameters binary"), "network").first()
    scratch.drop("network")
    if found is None:
        return None
    net = Network.__new__(Network)
    with np.load(BytesIO(found["parameters"])) as p:
        net.p = dict(p)
    return net


_SCORE = "_leafwork_toxicity"


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, without those that score 0.5 or more."""
    return scores(documents, fitted(documents, labels), documents.columns, _SCORE).filter(F.col(_SCORE) < 0.5).drop(_SCORE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    found = scores(documents, fitted(documents, common.table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
