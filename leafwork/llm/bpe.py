"""BPE encoding and decoding with per-prefix dynamic programming.

For every prefix of a piece of text its BPE encoding ends in one token, and that token is unique. An automaton with suffix
links over the vocabulary reports, at each position, the tokens that end there; a token is the last one of the prefix if the
prefix before it ends in a token with which it is compatible, that is, if no merge across their seam comes before the merges
that built them. The last token of every prefix is stored; back-pointers from the end give the exact ids.

Pieces are what the tokenizer's own split pattern gives; added special tokens are cut out first, as the library does. Work on
repeated words is saved by a bounded cache of chunks between spaces (see ``Chunks``).

The file's own settings decide: a byte-level BPE without a normaliser, whose pieces are split by the usual pattern, is what this
operator encodes; any other setting is an error, never wrong ids.

Null and empty texts have no ids. Very long texts are encoded whole. Repeated rows, and rows with a null doc_id, each get a row.
An empty table gives an empty one. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"

#: The split pattern of byte-level BPE tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The settings of a tokenizer file that this operator encodes by; what is left out there counts as given here.
SETTINGS = {
    "normalizer": {None: None}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
    "added_tokens": {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False},
}


def checked(spec: dict) -> dict:
    """The content of a tokenizer file; a ValueError where it asks for something else than SETTINGS."""

    def compare(what: str, found: dict | None) -> None:
        for key, value in SETTINGS[what].items():
            if key is None and found or key is not None and (found or {}).get(key, value if key != "type" else None) not in (value, "" if value is None else value):
                raise ValueError(f"tokenizer files with {what} {key or found}: {(found or {}).get(key)!r} aren't supported" if key else f"tokenizer files with a {what} aren't supported")

    compare("normalizer", spec.get("normalizer"))
    compare("pre_tokenizer", spec.get("pre_tokenizer"))
    compare("model", {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")})
    for token in spec.get("added_tokens", []):
        compare("added_tokens", token)
    return spec


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """Vocabulary files show a byte as a printable character: itself where it is one, else the next unused one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the automaton of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        of = byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes: dict[int, bytes] = {i: s.encode() for s, i in self.special.items()}
        ids: dict[str, int] = {}  # the key has one character (U+0000 to U+00FF) for each byte
        for token, i in spec["model"]["vocab"].items():
            if token not in self.special:
                raw = bytes(of[c] for c in token)
                self.bytes[i] = raw
                ids[raw.decode("latin-1")] = i
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        key = lambda s: ids[bytes(of[c] for c in s).decode("latin-1")]
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (key(a), key(b)), key(a + b)
            self.rank[pair] = k
            self.parts.setdefault(whole, (*pair, k))
        self.matcher = ahocorasick.Automaton()
        for s, i in ids.items():
            self.matcher.add_word(s, (len(s), i))
        self.matcher.make_automaton()
        self._single: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, list[int]] = {}
        self._split = regex.compile(PATTERN)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """t and what lies at one end of it (0 left, 1 right) as it is built, each with the rank of the merge that takes it up."""
        out, until = [], float("inf")
        while True:
            out.append((t, until))
            if t not in self.parts:
                return out
            until, t = self.parts[t][2], self.parts[t][side]

    def compatible(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge across the seam of a and b happens before ``before`` while they are built.

        A merge of x, the right end of a, and y, the left end of b, happens if its rank comes before those at which x and y
        are taken up; where it is the same merge, the place further left goes first.
        """
        for x, x_until in self._spine(a, 1):
            for y, y_until in self._spine(b, 0):
                k = self.rank.get((x, y))
                if k is not None and k < x_until and k <= y_until and k < before:
                    return False
        return True

    def single(self, t: int) -> bool:
        """Whether the bytes of t by themselves are encoded as t."""
        if (known := self._single.get(t)) is None:
            known = True
            if t in self.parts:
                a, b, k = self.parts[t]
                known = self.single(a) and self.single(b) and self.compatible(a, b, k)
            elif len(self.bytes[t]) > 1:
                known = False
            self._single[t] = known
        return known

    def piece(self, s: str) -> list[int]:
        """Ids of one piece, a character for each byte."""
        n = len(s)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        pairs = self._pairs
        for end, (size, t) in self.matcher.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start == 0:
                ok = self.single(t)
            else:
                key = last[start] << 20 | t
                if (ok := pairs.get(key)) is None:
                    if len(pairs) >= 250_000:
                        pairs.clear()
                    ok = pairs[key] = self.single(t) and self.compatible(last[start], t)
            if ok:
                last[end], back[end] = t, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for p in self._split.findall(part):
                if (ids := self._pieces.get(p)) is None:
                    ids = self.piece(p.encode().decode("latin-1"))
                    if len(p) <= 64:
                        if len(self._pieces) >= 60_000:
                            self._pieces.clear()
                        self._pieces[p] = ids
                out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Chunks:
    """Ids of whole texts from a bounded cache of ids of chunks.

    A split pattern of this kind never lets a piece run on over a space that follows a character other than white space, and
    whether it does over other spaces depends only on the characters beside them. So a text may be cut before each space,
    but for spaces with white space on both sides; texts that have those are encoded in one go. A piece ends, too, where a
    stop follows a letter or digit, and on both sides of a single newline between other characters; cuts there make the
    chunks fewer.

    Chunks are told apart by two independent hashes of 64 and 32 bits, all in numpy. encode_all encodes texts one by one. With sizes (the
    bytes of each token), unknown chunks are encoded as one text, which may be cut where they meet, and its ids are dealt out
    by their bytes.
    """

    MOST = 500_000
    _unsafe = re.compile(r"\s (?:\s|\Z)")
    _A, _B = common.mix(np.arange(512, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 256)
    _B = (_B >> np.uint64(32)).astype(np.uint32)
    # Last bytes of white space, and first ones, of any kind.
    _ENDS_BLANK = (np.arange(256) <= 32) | np.isin(np.arange(256), [0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)])
    _STARTS_BLANK = (np.arange(256) <= 32) | np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
    # First bytes, and first of the last three bytes, with which white space beyond ASCII can begin.
    _WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
    _BLANK = np.arange(256) <= 32
    _SOLID = (np.arange(256) > 32) & (np.arange(256) < 127)
    _STOP = np.isin(np.arange(256), np.frombuffer(b",.;:!?", np.uint8))
    _ALNUM = np.isin(np.arange(256), np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))

    def __init__(self, encode_all: Callable[[list[str]], list[list[int]]], sizes: np.ndarray | None = None, most: int = MOST):
        self.encode_all, self.sizes, self.MOST = encode_all, sizes, most
        self._clear()

    def _clear(self) -> None:
        self.h, self.h2, self.at = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)  # sorted by h
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inverse, size = common.powers(len(data), True)[starts], (ends - starts).astype(np.uint64)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._A[data] * common.powers(len(data)), out=prefix[1:])
        short = np.zeros(len(data) + 1, np.uint32)
        np.cumsum(self._B[data] * common.powers(len(data), half=True), out=short[1:], dtype=np.uint32)
        return common.mix((prefix[ends] - prefix[starts]) * inverse + size), (short[ends] - short[starts]) * inverse.astype(np.uint32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, h2: np.ndarray) -> None:
        size = ends - starts
        blank = self._BLANK[data[np.minimum(starts + 1, len(data) - 1)]] | self._BLANK[data[ends - 1]]
        plain = (data[starts] == 32) & (size > 1) & ~blank & ~self._edge_blank(data, starts, ends) if self.sizes is not None else np.zeros(len(starts), bool)
        ids, sizes = np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        joined = np.flatnonzero(plain)
        if len(joined):
            text = data[_ranges(starts[joined], size[joined])].tobytes().decode()
            ids = np.array(self.encode_all([text])[0], np.int64)
            got, want = np.cumsum(self.sizes[ids]), np.cumsum(size[joined])
            cut = np.searchsorted(got, want)
            if got[-1] == want[-1] and (got[cut] == want).all():
                sizes[joined] = np.diff(cut, prepend=-1)
            else:
                ids, joined, plain = np.zeros(0, np.uint32), joined[:0], np.zeros(len(starts), bool)
        rest = np.flatnonzero(~plain)
        each = self.encode_all([data[starts[k] : ends[k]].tobytes().decode() for k in rest]) if len(rest) else []
        sizes[rest] = [len(x) for x in each]
        order = np.concatenate((joined, rest))
        added = np.concatenate((ids, np.array([i for x in each for i in x], np.uint32))).astype(np.uint32)
        end = self.used + len(added)
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(added)), np.uint32)))
        self.pool[self.used : end] = added
        base = len(self.start)
        n = sizes[order]
        self.start, self.size = np.concatenate((self.start, self.used + np.cumsum(n) - n)), np.concatenate((self.size, n))
        self.used = end
        where = np.empty(len(order), np.int64)
        where[order] = base + np.arange(len(order))
        p = np.searchsorted(self.h, h)
        self.h, self.h2, self.at = np.insert(self.h, p, h), np.insert(self.h2, p, h2), np.insert(self.at, p, where)

    def _edge_blank(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which chunks have white space beyond ASCII behind their space or at their end."""
        out = np.zeros(len(starts), bool)
        wide = self._WIDE[data[np.minimum(starts + 1, len(data) - 1)]] | self._WIDE[data[np.maximum(ends - 2, 0)]] | self._WIDE[data[np.maximum(ends - 3, 0)]]
        for k in np.flatnonzero(wide):
            t = data[starts[k] : ends[k]].tobytes().decode()
            out[k] = t[1:2].isspace() or t[-1].isspace()
        return out

    def _suspicious(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which texts may have a space with white space on both sides, or at their end behind white space."""
        blank = self._STARTS_BLANK[data]
        follows = np.append(blank[1:], True)
        follows[first[1:] - 1] = True
        before = np.append(False, self._ENDS_BLANK[data[:-1]])
        return np.unique(np.searchsorted(first, np.flatnonzero((data == 32) & before & follows), "right") - 1)

    def many(self, texts: list[str] | list[bytes]) -> list[np.ndarray]:
        """Ids of each text; unknown chunks of all of them are learnt together."""
        raw_all = [t.encode() if isinstance(t, str) else t for t in texts]
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        safe = [k for k, t in enumerate(raw_all) if t]
        if not safe:
            return out
        raw = [raw_all[k] for k in safe]
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        unsafe = {safe[n] for n in self._suspicious(data, first) if self._unsafe.search(raw[n].decode())}
        if unsafe:
            for k in unsafe:
                out[k] = np.array(self.encode_all([raw_all[k].decode()])[0], np.uint32)
            safe = [k for k in safe if k not in unsafe]
            if not safe:
                return out
            raw = [raw_all[k] for k in safe]
            data = np.frombuffer(b"".join(raw), np.uint8)
            first = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        edge = data == 32
        solid, newline = self._SOLID[data], data == 10
        edge[1:] |= self._STOP[data[1:]] & self._ALNUM[data[:-1]]
        alone = newline[1:-1] & solid[:-2] & solid[2:]
        edge[1:-1] |= alone
        edge[2:] |= alone
        edge[first[:-1]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))
        h, h2 = self._hash(data, starts, ends)
        distinct, index, inverse = _distinct(h)
        second = h2[index]
        if (h2 != second[inverse]).any():  # two chunks with one hash: they aren't cached
            for k in safe:
                out[k] = np.array(self.encode_all([raw_all[k].decode()])[0], np.uint32)
            return out
        if len(self.h) + len(distinct) > self.MOST:
            fresh = ~self._known(distinct, second)[0]
            if len(self.h) + fresh.sum() > self.MOST:
                self._clear()
        known, _ = self._known(distinct, second)
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(data, starts[index[new]], ends[index[new]], distinct[new], second[new])
        known, at = self._known(distinct, second)
        if not known.all():  # the cache has another chunk under a hash
            self._clear()
            return self.many(texts)
        k = at[inverse]
        size = self.size[k]
        stop = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[_ranges(self.start[k], size)]
        bounds = stop[np.searchsorted(starts, first)]
        for n, k in enumerate(safe):
            out[k] = ids[bounds[n] : bounds[n + 1]]
        return out

    def _known(self, h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        p = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return (self.h[p] == h) & (self.h2[p] == h2), self.at[p]

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with the first index and the inverse, by hashing: only distinct values are sorted."""
    coded = pa.array(h).dictionary_encode()
    seen, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    first, rank = np.empty(len(seen), np.int64), np.empty(len(seen), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    order = np.argsort(seen)
    rank[order] = np.arange(len(seen))
    return seen[order], first[order], rank[code]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] values, then those of the next."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


_made: dict = {}


def worker_vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    if (path, "dp") not in _made:
        _made[path, "dp"] = Vocabulary(path)
    return _made[path, "dp"]


def _dp_chunks(path: str) -> Chunks:
    if (path, "dp chunks") not in _made:
        v = worker_vocabulary(path)
        _made[path, "dp chunks"] = Chunks(lambda texts: [v.encode(t) for t in texts])
    return _made[path, "dp chunks"]


def library_chunks(path: str, special: bool = True) -> Chunks:
    """The same cache before the tokenizers library; without special, special tokens' strings are ordinary text."""
    if (path, "library", special) not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        t.encode_special_tokens = not special
        of = worker_bytes(path)
        sizes = np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int64)
        _made[path, "library", special] = Chunks(lambda texts: [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)], sizes, 1_200_000)
    return _made[path, "library", special]


def _with(batch: pa.RecordBatch, drop: str, **columns: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns.values()], names=[*names, *columns])


def ids_of(texts: list[bytes], path: str, library: bool = False, kind: str = "<u4", tail: bytes = b"") -> list[bytes]:
    """The ids of each text, and ``tail``. Before the library, which is quick, steps are short: arrays of a step are most of a worker's memory."""
    chunks = (library_chunks if library else _dp_chunks)(path)
    most = common.STEP_BYTES // 2 if library else 2 * common.STEP_BYTES
    return [x.astype(kind).tobytes() + tail for a, z in common.steps(texts, most) for x in chunks.many(texts[a:z])]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", library: bool = False, kind: str = "<u4", end: int | None = None) -> DataFrame:
    """Replaces the text column by its ids: little-endian unsigned 32-bit integers (or those of ``kind``) as binary; with an end id, each text ends with it."""
    tail = b"" if end is None else np.array([end], kind).tobytes()
    common.prepare(df.sparkSession)

    def run(batch: pa.RecordBatch):
        yield _with(batch, text, **{ids: pa.array(ids_of(common.encoded(batch.column(text)), path, library, kind, tail), pa.binary())})

    schema = df.drop(text).withColumn(ids, F.lit(None).cast("binary")).schema
    return df.mapInArrow(common.by_batch(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Adds the text of the ids; unknown ids are an error, null is empty."""
    common.prepare(df.sparkSession)

    def run(batch: pa.RecordBatch):
        decoder = worker_decoder(path)
        texts = [decoder(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
        yield _with(batch, "" if keep_ids else ids, **{text: pa.array(texts, pa.string())})

    out = df if keep_ids else df.drop(ids)
    return df.mapInArrow(common.by_batch(run), out.withColumn(text, F.lit(None).cast("string")).schema)


class Decoder:
    """Bytes of many ids at once: the tokens' bytes lie behind one another, and a gather by offsets joins those asked for."""

    def __init__(self, of: dict[int, bytes]):
        n = max(of) + 1
        self.known = np.zeros(n, bool)
        self.known[list(of)] = True
        parts = [of.get(i, b"") for i in range(n)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        if len(ids) and (int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise KeyError("an id that no token has")
        return self.data[_ranges(self.start[ids], self.size[ids])].tobytes()


def worker_decoder(path: str) -> Decoder:
    if (path, "decoder") not in _made:
        _made[path, "decoder"] = Decoder(worker_bytes(path))
    return _made[path, "decoder"]


def worker_bytes(path: str) -> dict[int, bytes]:
    """Only the bytes of the tokens, for decoding."""
    if (path, "bytes") not in _made:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_of_char()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        _made[path, "bytes"] = {i: bytes(of[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special} | {i: t.encode() for t, i in special.items()}
    return _made[path, "bytes"]


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Replaces the text column by its ids and what they decode to, in one pass through Python."""
    common.prepare(df.sparkSession)

    def run(batch: pa.RecordBatch):
        chunks, decoder = _dp_chunks(path), worker_decoder(path)
        texts, out, back = common.encoded(batch.column(text)), [], []
        for a, z in common.steps(texts):
            for x in chunks.many(texts[a:z]):
                out.append(x.astype("<u4").tobytes())
                back.append(decoder(x).decode("utf-8", "replace"))
        yield _with(batch, text, **{ids: pa.array(out, pa.binary()), decoded: pa.array(back, pa.string())})

    schema = df.drop(text).withColumns({ids: F.lit(None).cast("binary"), decoded: F.lit(None).cast("string")}).schema
    return df.mapInArrow(common.by_batch(run), schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    both = round_trip(common.row_key(documents), path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), tokenizer_path())
