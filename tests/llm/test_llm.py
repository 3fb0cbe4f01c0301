"""Each operator against brute force, round trips or held-out accuracy, and its edge cases: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafwork.llm import ans_output, bpe, common, components, decontaminate, html_extract, ngram_join, substring_dedup, token_counts, topk, toxicity, url_rules
from leafwork.llm.queries import QUERIES, SQL

PATH = bpe.tokenizer_path()
CLASHES = {"unit": "long", "digest": "string", "ids": "string", "found": "int", "rid": "int", "score": "double", "_id": "int", "host": "string", "n": "int", "cut": "int", "own": "int", "tid": "long", "file": "string"}


def docs(spark, rows, more=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(None).cast(t) for k, t in CLASHES.items()}) if more else df


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# Queries against SQL --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    r = c.execute(SQL[name])
    columns = [d[0] for d in r.description]
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted(map(str, ([x[c] for c in order] for x in df.collect()))) == sorted(map(str, ([x[columns.index(c)] for c in order] for x in r.fetchall())))


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in names if q.startswith("op") and q[2].isdigit()} and "pipeline" in names


# 1 N-gram Jaccard join ------------------------------------------------------------------------------------------------


def brute_join(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    keys = list(texts)
    sets = []
    for t in keys:
        w = common.words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links, root = [0] * len(keys), list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(keys)), 2):
        n = len(sets[a] & sets[b])
        if n and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a], links[b] = links[a] + 1, links[b] + 1
            root[find(b)] = find(a)
    least = {}
    for k, t in enumerate(keys):
        least[find(k)] = min(least.get(find(k), 1 << 60), *texts[t])
    return sorted((i, least[find(k)] if sets[k] else i, links[k], len(texts[t]) if sets[k] else 1) for k, t in enumerate(keys) for i in texts[t])


def near_copies(seed, base_words, copies, edits, start):
    rng = random.Random(seed)
    base = words(rng, base_words).split()
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((start + k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_join_is_brute_force(spark, block):
    rng = random.Random(5)
    rows = near_copies(1, 300, 60, 8, 0) + near_copies(2, 40, 30, 2, 100) + [(200 + k, words(rng, 80)) for k in range(60)]
    common_part = words(rng, 30)
    rows += [(300 + k, common_part + " " + words(rng, 60)) for k in range(40)]
    rows += [(400, ""), (401, ""), (402, None), (403, "one two"), (404, "One two!"), (405, "one two"), (406, "!!!"), (407, "x " * 30_000), (408, "x " * 30_000 + "y"), (0, rows[0][1])]
    got = sorted(map(tuple, ngram_join.join(docs(spark, rows, True), block=block).select("doc_id", "class_id", "n_links", "n_copies").collect()))
    assert got == brute_join(rows)


def test_join_of_nothing(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    assert [tuple(r)[:2] for r in ngram_join.join(docs(spark, [(None, "a b c d e f")])).collect()] == [(None, None)]


def test_keep_one(spark):
    rows = near_copies(3, 100, 10, 1, 5) + [(1, "alone " * 3), (2, None), (3, ""), (None, "no id"), (5, near_copies(3, 100, 10, 1, 5)[0][1])]
    df = docs(spark, rows, True)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (1, 2, 3, None, 5)))


def test_keep_one_without_ids(spark):
    near = [t for _, t in near_copies(3, 100, 6, 1, 0)]
    rows = [(None, t) for t in near + near[:2]] + [(None, "solo text here"), (None, None), (None, None), (None, "!!")] + [(4, "given id " * 9), (None, "given id " * 9)]
    df = docs(spark, rows, True)
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()]
    assert sum(t in near for _, t in kept) == 1
    assert sorted(map(str, (r for r in kept if r[1] not in near))) == sorted(map(str, rows[8:12] + [rows[12]]))


def test_pruning_is_safe():
    """At 0.8, the chance to be dropped at any step is far below one in a million."""
    from math import comb

    drop = sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for n, least in ngram_join._LEAST.items() for k in range(least))
    assert drop < 1e-5 and ngram_join._LEAST[112] > 50


def test_components(spark, tmp_path):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t"), "c").collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)}


# 2 URL filters --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_urls(spark, most):
    """Both ways, rules shipped and rules dealt to ranges, against brute force."""
    rng = random.Random(1)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "notexample.net", "example.com", "org", "x.org", "host.example.org", "", "example.net.", "ünï.net"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}{rng.choice(['', '/', '/en/x', '/de/', '/en', '?q=/en/', '#a', '/en/?x#y'])}" for _ in range(300)]
    urls += [None, "", "no scheme/", "a://b://c/en/"] + ["https://hot.example.net/en/1"] * 200
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.example.net", "/"), ("allow", "ORG", ""), ("block", "example.com", "/de/"), ("block", None, "/"), ("allow", "a.example.net", "/"), ("allow", "b.a.example.net", "/en")]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, spark.createDataFrame(rules, "verdict string, host string, path string"), ["page_id"], most).collect()}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(len(h) + len(p), len(h), v == "block", h.lower() + p, v) for v, h, p in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fit, default=(0, 0, 0, None, "allow"))
        assert got[k] == (host, path, best[3], best[4]), u


def test_urls_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert url_rules.judge(empty, none, ["page_id"]).count() == 0


# 3, 6, 8 Tokens -------------------------------------------------------------------------------------------------------

ODD = ["", "  a", "a  b   c", " x\n \n y ", "<|endoftext|>a <|endoftext|>", "I'm we'll 'S", "é漢字😀 😀　 x", "a\x1cb \x85 !\x1c!", "a" * 40, "١٢٣ Ⅷ ½ x́", "\n\n\n foo\n\n\n bar ", "   ", "<|endof", "a b 　c", "don't 3's a_b ...", "x.\ny. \nz.\n\nw"]


def test_bpe_is_the_library(library):
    rng = random.Random(0)
    alphabet = "ab cd\n  the .,'é漢!1 \t"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for make in (bpe._dp_chunks, bpe.library_chunks):
        assert [x.tolist() for x in make(PATH).many(texts)] == want
    v = bpe.worker_vocabulary(PATH)
    assert [v.encode(t) for t in texts] == want
    assert [v.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_bounded_cache_gives_the_same(library):
    v = bpe.worker_vocabulary(PATH)
    c = bpe.Chunks(lambda texts: [v.encode(t) for t in texts])
    c.MOST = 20
    texts = [f"alpha{k} beta{k % 7} gamma, delta{k % 3}." for k in range(100)]
    assert [x.tolist() for a in range(0, 100, 9) for x in c.many(texts[a : a + 9])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_digests(spark, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(99, None), (99, None), (None, "x"), (100, "long words " * 20_000)]
    got = sorted((tuple(r) for r in bpe.digests(docs(spark, rows, True), PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str) and bpe.digests(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 8191, 8192, 8193, 65536, 65537, 150_000])
def test_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).astype(np.int64) % 50_257
    coder = ans_output.Coder(ans_output.quantised(np.bincount(ids, minlength=50_257)))
    docs_, sizes, back = ans_output.unpack(coder, ans_output.pack(coder, [None, 3], np.array([n, 0]), ids))
    assert docs_ == [None, 3] and sizes.tolist() == [n, 0] and (back == ids).all()


def test_coder_on_symbols_it_never_saw_and_damage():
    coder = ans_output.Coder(ans_output.quantised(np.zeros(50_257, np.int64)))
    ids = np.arange(50_257)
    data = bytearray(ans_output.pack(coder, [0], np.array([len(ids)]), ids))
    assert (ans_output.unpack(coder, bytes(data))[2] == ids).all()
    data[-1000] ^= 1
    with pytest.raises(ValueError):
        ans_output.unpack(coder, bytes(data))


def test_token_files(spark, library):
    rows = [(5, "b b"), (3, None), (9, "c!" * 5000), (3, "again"), (1, "<|endoftext|>!"), (5, "b b"), (None, "first")]
    scratch = common.Scratch(spark, "t")
    manifest, f = ans_output.write(docs(spark, rows, True), PATH, scratch)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in ans_output.read(manifest, f).orderBy("start").collect()]
    start = 0
    for (i, t), x in zip(sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")), got):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert x == (i, start, ids)
        start += len(ids)
    manifest, f = ans_output.write(docs(spark, []), PATH, common.Scratch(spark, "t"))
    assert ans_output.read(manifest, f).count() == 0


def test_output_query(spark, data, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_token_output"](spark, data).collect()}
    start = 0
    for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_separator_scan(block):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50):
        ids = rng.integers(0, 4, n).astype("<u2")
        lengths, left = token_counts.scan(ids, 3, block)
        want, now = [], 0
        for i in ids:
            if i == 3:
                want.append(now)
                now = 0
            else:
                now += 1
        assert lengths.tolist() == want and left == now


def test_flat_files(spark, library):
    rows = [(1, "a b"), (2, None), (3, ""), (4, "word " * 9000), (4, "word"), (None, "x"), (6, "a <|endoftext|> b")]
    library = type(library).from_file(PATH)
    library.encode_special_tokens = True
    scratch = common.Scratch(spark, "t")
    files, order = token_counts.write(docs(spark, rows, True), PATH, scratch)
    counts = token_counts.placed(token_counts.count(files, block=1000))
    got = sorted(((r.doc_id, r.n_tokens, r.closed) for r in counts.join(order, ["file", "ordinal"]).collect()), key=str)
    assert got == sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids), True) for i, t in rows), key=str)
    total = counts.agg(F.sum("n_tokens")).first()[0]
    assert counts.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == total
    files, order = token_counts.write(docs(spark, []), PATH, common.Scratch(spark, "t"))
    assert token_counts.count(files).count() == 0


def test_count_query(spark, data, library):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op8_token_counts"](spark, data).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


# 4 Toxicity -----------------------------------------------------------------------------------------------------------


def test_gradients():
    texts = [b"one bad word here", b"another fine text with more words " * 6]
    w = toxicity.Words(texts)
    places, _ = w.windows()
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y = np.array([1.0, *[0.0] * (len(places) - 1)])
    loss, g = net.gradients(w, places, y)
    for name in ("wx", "bx", "uf", "ub", "wa", "ba", "va", "wo", "bo"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, eps = net.p[name][at], 1e-3
        net.p[name][at] = old + eps
        up = net.gradients(w, places, y)[0]
        net.p[name][at] = old - eps
        down = net.gradients(w, places, y)[0]
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3 + 0.02 * abs(g[name][at]), name


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        w = toxicity.Words([b"x", b" ".join(b"w%d" % k for k in range(n)), b""])
        places, text = w.windows()
        seen = {int(p) for p in places[text == 1].ravel() if p >= 0}
        assert len(seen) == n and (text == 2).sum() == 0


def test_toxicity_on_held_out(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(500):
        t = words(rng, rng.randrange(5, 150), 800).split()
        toxic = k % 4 == 0
        for _ in range(2 * toxic):
            t.insert(rng.randrange(len(t) + 1), f"vile{rng.choice(['', 'st', 'ness', 'ly'])}")
        rows.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "!!"), (1003, "calm " * 30_000), (1003, "calm " * 30_000)]
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (9, 1), (9, 0)], "doc_id long, toxic int")
    df = docs(spark, rows, True)
    net = toxicity.fitted(df, lab)
    got = {r.doc_id: r.score for r in toxicity.scores(df.drop("score"), net, ["doc_id"]).collect()}
    held = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in held]) >= 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] == got[1002] == 0.0
    kept = toxicity.clean(df.drop("score"), lab)
    assert kept.columns == df.drop("score").columns and kept.count() < df.count()


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scores(docs(spark, [(1, "a b")]), toxicity.fitted(docs(spark, [(1, "a b")]), none), ["doc_id"]).collect()] == [0.0]
    assert toxicity.scores(docs(spark, []), None, ["doc_id"]).count() == 0


# 5 HTML ---------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site, name, motto</p></header>
<nav><ul><li><a href=/a>One</a></li></ul></nav><div class="cookie-notice"><p>We, use, cookies, here</p></div><div class="ad">Buy &amp; buy</div>
<div class=content><h1>Title &amp; more</h1><p>First, a paragraph with <b>bold</b> text,
 and&nbsp;more of it, so that it is long enough.<p>Second<br>line &lt;b&gt;<ul><li>item</ul></div>
<aside><p>Aside, aside</p></aside><form><p>Name</p></form><div id="comments"><p>Nice, very nice, indeed, really</p></div><footer>&copy; me</footer></body></html>"""


def test_html():
    assert html_extract.extract(PAGE) == "Title & more First, a paragraph with bold text, and more of it, so that it is long enough. Second line <b> item"
    assert [html_extract.extract(x) for x in (None, "", "   ", "<", "<!-- a", "<p", "<script>x", "plain  text &amp")] == ["", "", "", "<", "", "", "", "plain text &"]
    assert html_extract.extract("<div>" * 20_000 + "deep") == "deep"
    assert html_extract.extract("<body><p>x</b></i></div>y</p><td>z") in ("x y z", "xy z")


def test_html_table(spark, data):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.texts(df, "page_id", "url").collect()
    assert len(got) == 3 and got[0] == got[1] and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.texts(df.limit(0), "page_id").count() == 0
    import html
    import re

    found = {r.page_id: r.text for r in QUERIES["op5_html_extraction"](spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        parts = re.split(r"</?(?:p|br|h1)\b[^>]*>", re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1])
        want = " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in parts) if x)
        assert found[r.page_id] == want


# 7 Substring dedup ----------------------------------------------------------------------------------------------------


def test_chunks_resist_shifts():
    rng = random.Random(4)
    passage = words(rng, 80)
    a, b = (list(substring_dedup.chunks([x.encode()]))[0] for x in (words(rng, 30) + " " + passage, "é" + words(rng, 7) + " " + passage + " " + words(rng, 9)))
    shared = set(a[0]) & set(b[0])
    assert sum(w for d, w in zip(a[0], a[2]) if d in shared) >= 60
    for text in ("", "x", "é" * 3000, "a" * 5000):
        d, chars, n = list(substring_dedup.chunks([text.encode(), b"other"]))[0]
        assert chars.sum() == len(text) and len(d) == len(chars) == len(n)


def test_repeats(spark):
    rng = random.Random(6)
    passage, line = words(rng, 70), words(rng, 8)
    clean = [(k, line + "\n" + words(rng, 120)) for k in range(10, 30)]
    dirty = [(k, words(rng, 40) + " " + passage + " " + words(rng, 40)) for k in range(4)]
    rows = clean + dirty + [(50, ""), (51, None), (52, "z" * 100_000), (3, dirty[3][1]), (60, clean[0][1] + " tail")]
    df = docs(spark, rows, True)
    found = {r.doc_id: (r.repeated, r.cut) for r in substring_dedup.find(df).collect()}
    assert set(found) == {0, 1, 2, 3, 10, 60} and not found[0][1] and not found[10][1] and all(found[k][1] for k in (1, 2, 3, 60))
    after = substring_dedup.cut_repeats(df)
    assert after.columns == df.columns and after.count() == df.count()
    texts = {r.doc_id: r.text for r in after.collect()}
    middle = passage[120:-120]
    assert middle in texts[0] and not any(middle in texts[k] for k in (1, 2, 3)) and all(texts[k] == t for k, t in clean) and texts[51] is None
    assert substring_dedup.find(docs(spark, [])).count() == 0


def test_every_long_passage_is_caught(spark):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        p = words(rng, 60)
        rows += [(2 * k, words(rng, 20) + " " + p), (2 * k + 1, p + " " + words(rng, 20))]
    assert substring_dedup.find(docs(spark, rows)).count() >= 236


def missed(passages, glue=" "):
    """Of passages that stand in two different contexts, those without a run of common chunks of enough words."""
    rng, out = random.Random(12), []
    for p in passages:
        (a, _, _), (b, _, n) = substring_dedup.chunks([(words(rng, 60) + glue + p + glue + words(rng, 60)).encode() for _ in range(2)])
        if not substring_dedup.runs(np.isin(b, a), n, substring_dedup.MIN_WORDS):
            out.append(p)
    return out


def test_every_passage_of_50_words_is_caught(spark):
    rng = random.Random(11)
    for n in (50, 51, 55, 70):
        assert not missed(words(rng, n) for _ in range(500))
    letters = [" ".join(rng.choices("abcdefgh", k=50)) for _ in range(500)]
    assert not missed(letters) and not missed(letters, "yy") and not missed(words(rng, 51, 30) for _ in range(500))
    rows = []
    for k in range(150):
        p = words(rng, 51)
        rows += [(2 * k, words(rng, 40) + " " + p + " " + words(rng, 40)), (2 * k + 1, words(rng, 40) + " " + p + " " + words(rng, 40))]
    assert substring_dedup.find(docs(spark, rows)).count() == 300


def test_passages_of_one_line_are_caught(spark):
    rng = random.Random(13)
    lines = [words(rng, rng.randrange(1, 15)) for _ in range(400)]
    repeated = ["\n".join([x] * max(20, -(-51 // len(x.split())))) for x in lines]
    assert not missed(repeated, "\n") and not missed(["w5 " * 5000])
    rows = [(2 * k + j, words(rng, 40) + "\n" + p + "\n" + words(rng, 40)) for k, p in enumerate(repeated[:100]) for j in range(2)]
    found = {r.doc_id: r for r in substring_dedup.find(docs(spark, rows)).collect()}
    assert len(found) == 200 and all(found[2 * k + 1].cut for k in range(100))


def test_rows_without_an_id_or_with_one_id_are_cut(spark):
    rng = random.Random(14)
    p, q = words(rng, 80), words(rng, 80)
    rows = [(i, words(rng, 40) + " " + x + " " + words(rng, 40)) for i, x in ((None, p), (None, p), (None, p), (7, q), (7, q), (8, words(rng, 80)))]
    after = [r.text for r in substring_dedup.cut_repeats(docs(spark, rows, True)).collect()]
    assert [sum(x[90:-90] in t for t in after) for x in (p, q)] == [1, 1] and rows[5][1] in after


# 9 Decontamination ----------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    w = common.words_of(text)
    hit, found = set(), set()
    for i, t in items:
        iw = common.words_of(t)
        m = min(10, len(iw))
        for a in range(len(iw) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == iw[a : a + m]:
                    hit |= set(range(p, p + m))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_decontamination_is_brute_force(spark, most):
    rng = random.Random(9)
    items = [(k, words(rng, n, 6)) for k, n in enumerate([1, 2, 3, 9, 10, 11, 25, 0, 12])] + [(20, None), (None, "w1 w2"), (6, words(rng, 12, 6)), (21, words(rng, 40))]
    rows = [(k, words(rng, rng.randrange(60), 8)) for k in range(60)] + [(70, items[12][1].upper() + "!"), (71, None), (72, ""), (73, "w9 " * 50_000), (73, "w9")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("found", F.lit(1))
    got = sorted(map(tuple, decontaminate.find(docs(spark, rows, True), bench, most).drop("text", "found").collect()))
    known = [(i, t) for i, t in items if i is not None and t is not None]
    assert got == sorted((i, *brute_hits(t, known)) for i, t in rows)
    kept = decontaminate.clean(docs(spark, rows, True), bench, most)
    assert kept.count() == sum(not r[-1] for r in got)


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs(spark, []), none).count() == 0
    assert [r.contaminated for r in decontaminate.find(docs(spark, [(1, "a b")]), none).collect()] == [False]


# 10 Exact top-k -------------------------------------------------------------------------------------------------------


def test_topk_is_brute_force(spark):
    rng = random.Random(11)
    rows = [(k, [rng.choice([0.0, 0.5, -0.25, 1.5, rng.random()]) for _ in range(6)]) for k in range(150)]
    rows += [(200 + k, [1.0] * 6) for k in range(30)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (50, [1.0] * 6), (None, [1.0] * 6), (200, [1.0] * 6), (400, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("w", F.lit(1)).withColumn("qb", F.lit(1))
    v = topk.weights(df)
    got = sorted(map(tuple, topk.search(v.filter("vec_id % 50 = 0"), v, query_block=3, candidate_block=16).collect()))
    sound = {(i, tuple(int(np.floor(256.0 * float(np.float32(c)))) for c in x)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    want = []
    for q in sorted({i for i, _ in sound if i % 50 == 0}):
        best = {(-sum(a * b for a, b in zip(x, y)), j) for i, x in sound if i == q for j, y in sound if j != q}
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(sorted(best)[:5])]
    assert got == sorted(want)
    assert topk.search(v.limit(0), v).count() == 0 and topk.search(v.limit(1), v.limit(1)).count() == 0


def test_empty_vectors_score_zero(spark):
    df = spark.createDataFrame([(0, []), (1, [-1.0, 0.5]), (2, [1.0]), (50, [1.0, 0.0]), (51, [])], "vec_id long, embedding array<float>")
    v = topk.weights(df)
    got = sorted(map(tuple, topk.search(v.filter("vec_id % 50 = 0"), v).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 50, 0), (0, 4, 51, 0), (50, 1, 2, 65536), (50, 2, 0, 0), (50, 3, 51, 0), (50, 4, 1, -65536)]
    none = v.filter("vec_id in (0, 51)")
    assert sorted(map(tuple, topk.search(none, none).collect())) == [(0, 1, 51, 0), (51, 1, 0, 0)]


# Pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, data):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "bpe"]
    d = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, d, data)
        assert out.columns == d.columns, name
        assert 0 < out.count() <= d.count()
    assert stage is p.STAGES[-2][1]
    last = p.run(spark, data)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() > 0.5 * d.count()


def test_batches_of_arrow_views():
    a = pa.array([b"ab", b"", b"cde"], pa.binary())
    assert [bytes(x) for x in common.joined(a.slice(1))] == [b"cde"]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_intersections(at_once):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 64, 30, np.uint64, endpoint=False)) for _ in range(6)]
    sets += [np.unique(np.concatenate((sets[0][:20], sets[1][5:]))), np.zeros(0, np.uint64), np.array([0, (1 << 64) - 1], np.uint64), np.array([0], np.uint64)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = ngram_join.shared(sets, at_once)
    assert all(got[i, j] == want[i][j] for i in range(len(sets)) for j in range(len(sets)) if i != j)


def planted(rng, n, size, copies=1):
    rows, labels = [], []
    for k in range(n):
        t = words(rng, rng.randrange(*size), 800).split()
        toxic = k % 4 == 0
        for _ in range(2 * copies * toxic):
            t.insert(rng.randrange(len(t) + 1), f"vile{rng.choice(['', 'st', 'ness', 'ly'])}")
        rows.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxic_texts_of_any_length_are_learnt_from(spark):
    rng = random.Random(21)
    rows, labels = planted(rng, 60, (4600, 5200), 5)
    rows = [(i, t) for i, t in rows if i % 4 == 0] + [(i, t[:600]) for i, t in rows if i % 4]
    assert all(len(t) > 20_000 for i, t in rows if i % 4 == 0)
    df, lab = docs(spark, rows, True), spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = toxicity.clean(df, lab)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i % 4 > 0 for i in ids) >= 43 and sum(i % 4 == 0 for i in ids) <= 2


def test_sample_is_of_documents_that_exist(spark, monkeypatch):
    rng = random.Random(22)
    rows, labels = planted(rng, 80, (5, 40))
    rows += [(3, rows[3][1]), (None, "no id"), (200, None), (201, "z " * 400_000)]
    labels += [(k, k % 2) for k in range(1000, 3000)] + [(200, 1), (201, 1)]
    monkeypatch.setattr(toxicity, "DRAW", 1)
    monkeypatch.setattr(toxicity, "POSITIVE", 15)
    monkeypatch.setattr(toxicity, "NEGATIVE", 50)
    got = toxicity.sample(docs(spark, rows, True), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    texts = dict(rows[:80])
    train = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5]
    assert sum(r.toxic for r in got) <= 15 and sum(not r.toxic for r in got) == min(50, sum(i % 4 > 0 for i in train))
    assert sum(r.toxic for r in got) >= 14 and all(r.text == texts[r.doc_id] for r in got if r.doc_id < 200)
    assert all(len(r.text) <= toxicity.LONG + toxicity.STRETCHES for r in got)


BODY = "<p>One sentence, and more of it, with words enough.</p><p>Another, longer sentence, so that the article has some points to show.</p>"
JUNK = "<p>Junk one, with commas, many, many, and text, and words, and more of them here.</p><p>Junk two, with commas, and yet more text, and words, and so on, and on.</p>"
WANT = "One sentence, and more of it, with words enough. Another, longer sentence, so that the article has some points to show."


@pytest.mark.parametrize("name", ["page-sidebar", "main-nav", "entry-comments", "post-share", "content-ad", "page-footer", "story-related", "main-menu", "post-comments", "pageSidebar", "cookie-notice", "comment-body", "page-header", "site-header"])
def test_furniture_is_left_out_in_and_beside_the_article(name):
    for page in (f'<div class="article">{BODY}<div class="{name}">{JUNK}</div></div>', f'<div class="article">{BODY}</div><div id="{name}">{JUNK}</div>', f"<div class='{name} wide'>{JUNK}</div><article>{BODY}</article>", f"<article>{BODY}<section class={name}>{JUNK}</section></article>"):
        assert html_extract.extract(f"<html><body>{page}</body></html>") == WANT


@pytest.mark.parametrize("name", ["content has-sidebar", "post comments-open", "article tag-page", "no-ads", "ad-free", "banner-content", "entry-header", "shared", "headers", "additional"])
def test_names_that_only_look_like_furniture(name):
    assert html_extract.extract(f'<body><div class="{name}">{BODY}</div></body>') == WANT


def test_html_details():
    x = html_extract.extract
    assert x("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, <object>shown</object> <audio>heard</audio> <svg><text>drawn</text></svg></p>") == "if x=1, shown heard drawn"
    assert x("<p><b>&am</b>p; &amp;lt; &lt;b&gt;</p>") == "&amp; &lt; <b>"
    assert x(f"<body><div>{BODY}</div><p>Short end.</p><p>No end</p><p><a href=x>Link end.</a></p></body>") == WANT + " Short end."
    assert x(f"<body><article><h1>Title</h1><div>{BODY}</div><p>by me</p></article><div class=footer>f</div></body>") == f"Title {WANT} by me"
    assert x(f"<body><div>{BODY}</div><h2>Next</h2><div>{BODY}</div></body>") == f"{WANT} Next {WANT}"
    assert x("<div><a href=/x/>in</a> a link's text, <a title='a>b' href=\"'\">two</a> and more text of it.</div>") == "in a link's text, two and more text of it."
    # Containers of equal scores: the first wins, and its equal sibling is near it.
    assert x("<body><section><div><p>aa, bb</p></div></section><section><div><p>cc, dd</p></div></section></body>") == "aa, bb"


@pytest.mark.parametrize("shape", ["<blockquote>xx ", "<svg/>", "</x>", "<textarea>", "<p a='", "<!--", "<div><p>a, ", "&amp", "<", "<a b=c "])
def test_hostile_pages_take_time_by_their_length(shape):
    import time

    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        html_extract.extract(shape * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 0.5 + 8 * took[0]


def test_html_without_article_elements(spark, data):
    import html
    import re

    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|br|h1)\b[^>]*>", inner)
        want = " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in parts) if x)
        for opened in ("<div class=story>", "<div>", "<section><div id='main-text'>"):
            page = r.html.replace("<article>", opened).replace("</article>", "</div>" + "</section>" * opened.startswith("<section>"))
            assert html_extract.extract(page) == want


def test_html_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", 3), (2, None, 4)], "page_id long, html string, n int")
    assert sorted(map(tuple, html_extract.texts(df, "html", "n").collect()), key=str) == [("<p>x</p>", 3, "x", 1), (None, 4, "", 0)]


def test_one_vector_under_many_ids_and_many_vectors_under_one_id(spark):
    same = [(k, [1.0, 2.0]) for k in range(60)] + [(0, [1.0, 2.0])] * 40 + [(7, [float(k), 1.0]) for k in range(40)]
    v = topk.weights(spark.createDataFrame(same, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, topk.search(v.filter("vec_id % 50 = 0"), v, query_block=2, candidate_block=8).collect()))
    assert got == [(q, r, 7, s) for q in (0, 50) for r, s in zip(range(1, 6), [(39 - j + 2) * 65536 for j in range(5)])]


def test_weights_beyond_64_bits(spark):
    v = topk.weights(spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 0.0]), (50, [3e38])], "vec_id long, embedding array<double>"))
    w = {r.vec_id: r.w for r in v.collect()}
    assert w[0] == [(1 << 63) - 1, 256] and w[1] == [-(1 << 63), 0] and w[50] == [(1 << 63) - 1]
    wrapped = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    got = {(r.query_id, r.vec_id): r.score for r in topk.search(v.filter("vec_id % 50 = 0"), v).collect()}
    assert got[0, 50] == wrapped(((1 << 63) - 1) ** 2) and got[0, 1] == wrapped(-((1 << 63) - 1) * (1 << 63))


def brute_separators(ids, end):
    out, now, at = [], 0, 0
    for k, i in enumerate(ids):
        if i == end:
            out.append((now, at, True))
            now, at = 0, k + 1
        else:
            now += 1
    return out + ([(now, at, False)] if now else [])


@pytest.mark.parametrize("run", [1, 3, 1024])
def test_separators_across_many_blocks(spark, monkeypatch, run):
    """One file is cut into many rows and tasks; documents lie across several cuts, blocks without separators among them."""
    monkeypatch.setattr(token_counts, "RUN", run)
    rng = np.random.default_rng(7)
    files = {"long": np.concatenate([rng.integers(0, 50, 900), np.full(300, 1), [9, 9], rng.integers(0, 50, 100)]), "open": np.array([1, 2, 3]), "none": np.zeros(0, int), "ends": np.array([9, 9, 1, 9])}
    rows = []
    for name, ids in files.items():
        cuts = [0, *sorted(rng.integers(0, len(ids) + 1, 40).tolist()), len(ids)] if name == "long" else [0, len(ids)]
        rows += [(name, k, ids[a:z].astype("<u2").tobytes()) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:]))]
    rows.append(("empty", 0, None))
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, int(b), bytes(c) if c is not None else None) for a, b, c in rows], token_counts.BLOCKS).repartition(7)
    got = token_counts.placed(token_counts.count(df, 9, 5)).collect()
    start = 0
    for name in sorted(files):
        mine = [(r.n_tokens, r.offset, r.closed) for r in sorted(got, key=lambda r: r.ordinal) if r.file == name]
        assert mine == brute_separators(files[name].tolist(), 9), name
        for r in sorted((r for r in got if r.file == name), key=lambda r: r.ordinal):
            assert r.start == start
            start += r.n_tokens


def test_raw_files(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 7, 9, 8])
    (tmp_path / "a.u16").write_bytes(ids.astype("<u2").tobytes())
    (tmp_path / "b.u16").write_bytes(b"")
    got = token_counts.count(token_counts.blocks_of(spark, str(tmp_path)), 9)
    assert sorted((r.n_tokens, r.offset, r.closed) for r in got.collect()) == sorted(brute_separators(ids.tolist(), 9))


def test_flat_blocks_are_cut_anywhere(spark, library):
    rng = random.Random(31)
    rows = [(k, words(rng, rng.randrange(60))) for k in range(200)]
    scratch = common.Scratch(spark, "t")
    files, order = token_counts.write(docs(spark, rows), PATH, scratch, block=64)
    assert files.groupBy("file").count().agg(F.max("count")).first()[0] > 20
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.count(files).join(order, ["file", "ordinal"]).collect())
    assert got == [(i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows]


def test_ids_beyond_16_bits_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(bpe, "library_chunks", lambda *a, **k: type("C", (), {"many": lambda self, t: [np.array([70_000], np.uint32)] * len(t)})())
    source = docs(spark, [(1, "x")])
    captured = {}
    monkeypatch.setattr(common, "frugal", lambda f: captured.setdefault("run", f))
    with pytest.raises(Exception):
        token_counts.write(source, PATH, type("S", (), {"write": lambda *a, **k: 1 / 0})())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["x"], "task": [0]})
    with pytest.raises(ValueError, match="70000"):
        list(captured["run"]([batch]))


def test_rows_of_one_id_can_be_split(spark, library, monkeypatch):
    """All rows share an id; they still go to several ranges, and every place is right."""
    monkeypatch.setattr(ans_output, "FILE_TOKENS", 100)
    rng = random.Random(41)
    rows = [(None if k % 3 else 5, words(rng, rng.randrange(1, 30))) for k in range(120)] + [(5, "same")] * 60
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows become one partition
    try:
        files, f = ans_output.write(docs(spark, rows, True).repartition(6), PATH, common.Scratch(spark, "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.select("shard").distinct().count() == 4 and files.count() > 12
    got = ans_output.read(files, f).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    ids = lambda t: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), ids(t)) for i, t in rows)


def brute_repeats(rows, size):
    """doc -> (covered words, words to cut), by windows of words over distinct (id, text) rows."""
    documents = sorted({(i, t) for i, t in rows})
    seen, first = {}, {}
    for i, t in documents:
        w = t.split()
        for a in range(len(w) - size + 1):
            key = tuple(w[a : a + size])
            seen[key] = seen.get(key, 0) + 1
            first.setdefault(key, (i, a))
    out = {}
    for i, t in documents:
        w, repeated, later = t.split(), set(), set()
        for a in range(len(w) - size + 1):
            key = tuple(w[a : a + size])
            if seen[key] > 1:
                repeated |= set(range(a, a + size))
                if first[key] != (i, a):
                    later |= set(range(a, a + size))
        if repeated:
            out[i] = len(repeated), len(later), [x for k, x in enumerate(w) if k not in later]
    return out


def test_repeats_are_brute_force(spark):
    rng = random.Random(51)
    passages = [words(rng, n) for n in (30, 40, 46, 47, 48, 49, 50, 51, 60, 200)] + [" ".join(rng.choices("ab", k=70)), " ".join(["abc"] * 60), "\n".join([words(rng, 9)] * 8)]
    rows = []
    for k in range(150):
        parts = [words(rng, rng.randrange(1, 60))]
        for p in rng.sample(passages, rng.randrange(3)):
            parts += [p, words(rng, rng.randrange(60))]
        rows.append((k, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [rows[7], rows[9], rows[9]]
    most, least = brute_repeats(rows, substring_dedup.LEAST), brute_repeats(rows, substring_dedup.PASSAGE)
    df = docs(spark, rows, True)
    got = {r.doc_id: (sum(s.words for s in r.repeated), sum(s.words for s in r.cut), len(r.repeated)) for r in substring_dedup.find(df).collect()}
    assert set(least) <= set(got) <= set(most) and len(least) > 70
    ends = 2 * (substring_dedup.SPREAD - 1)
    for i, (repeated, cut, n) in got.items():
        assert repeated <= most[i][0] and cut <= most[i][1]
        assert i not in least or (repeated >= least[i][0] - ends * n and cut >= least[i][1] - ends * n)
    for r in substring_dedup.cut_repeats(df).collect():
        w, old = r.text.split(), dict(rows)[r.doc_id].split()
        assert len(w) == len(old) - got.get(r.doc_id, (0, 0))[1] and (r.doc_id in got or w == old)


def test_windows_of_words():
    text = "é a b  c\nd e f\tg".encode()
    sizes, bounds, at, hashes = substring_dedup.windows(text, [0, 3, 4, 90], 3)
    assert sizes.tolist() == [3, 4] and bounds.tolist() == [0, 2, 4, 7, 9, 11, 13, 15, 16] and at[0] == 0 and set(at[1:]) <= {3, 4} and len(hashes) == 2
    assert [len(x) for x in substring_dedup.windows(b"", [0, 5])] == [0] * 4
    rng = random.Random(3)
    p = words(rng, substring_dedup.PASSAGE)
    for _ in range(200):
        a, b = (substring_dedup.windows((words(rng, 60) + " " + p + " " + words(rng, 60)).encode(), [0, 999])[3] for _ in range(2))
        assert len(np.intersect1d(a, b))


def test_join_in_blocks_of_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4000)
    rng = random.Random(61)
    rows = near_copies(62, 200, 30, 6, 0) + [(100 + k, words(rng, 50)) for k in range(10)] + near_copies(63, 2000, 4, 20, 200)
    got = sorted(map(tuple, ngram_join.join(docs(spark, rows)).select("doc_id", "class_id", "n_links", "n_copies").collect()))
    assert got == brute_join(rows)


def test_recall_against_all_pairs(spark, data):
    """Every document of the table against every other, exactly."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op1_ngram_join"](spark, data).collect()))
    assert got == brute_join(rows)


def test_other_tokenizers_are_an_error(tmp_path):
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {**spec["model"], "ignore_merges": True}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError, match="supported"):
            bpe.checked({**spec, **change})
    assert bpe.checked(spec) is spec
    with pytest.raises(ValueError):
        bpe.Vocabulary(PATH.replace("byte_bpe_50k", "word_bpe_49k"))


def test_decoder(library):
    d = bpe.Decoder(bpe.worker_bytes(PATH))
    ids = np.random.default_rng(1).integers(0, 50_257, 5000)
    assert d(ids).decode("utf-8", "replace") == library.decode(ids.tolist(), skip_special_tokens=False) and d(ids[:0]) == b""
    with pytest.raises(KeyError):
        d(np.array([50_257]))


def test_kept_columns_named_like_results(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "x")], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")
    with pytest.raises(ValueError, match="host"):
        url_rules.judge(df, rules, ["page_id", "host"])
    assert [tuple(r) for r in url_rules.judge(df.withColumnRenamed("host", "n"), rules, ["n", "url"]).collect()] == [("x", "http://a.net/", "a.net", "/", "net/", "block")]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def corpus(spark, at, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline_is_brute_force(spark, tmp_path, library):
    """All stages behind the network against plain versions of them, on what the network keeps; nulls, empties, repeats and a clashing column."""
    import corpus_pipeline as p

    rng = random.Random(71)
    passage, item = words(rng, 80), words(rng, 14)
    texts, labels = planted(rng, 120, (20, 90))
    rows = [(i, t) for i, t in texts] + [(200 + i, t) for i, t in near_copies(72, 120, 6, 1, 0)]
    rows += [(300 + k, words(rng, 30) + " " + passage + " " + words(rng, 30)) for k in range(4)] + [(400, words(rng, 20) + " " + item + " end"), (401, None), (402, ""), (403, "?!"), (404, words(rng, 4000, 800)), (1, texts[1][1])]
    full = [(i, t, "en", None, len(t) if t is not None else None, "x") for i, t in rows]
    d = corpus(spark, tmp_path, full, [(i, 1, y) for i, y in labels], [(1, item), (2, None), (3, "")])
    got = sorted(map(tuple, p.run(spark, d).collect()))

    docs_ = spark.read.parquet(f"{d}/documents.parquet")
    first = p.STAGES[0][1](spark, docs_, d)
    assert first.columns == docs_.columns
    left = {}
    for r in first.collect():
        left[r.doc_id] = r.text
    kept = {i: left[i] for i, c, _, _ in brute_join(list(left.items())) if i == c}
    cuts = brute_repeats([(i, t or "") for i, t in kept.items()], substring_dedup.PASSAGE)
    after = {i: " ".join(cuts[i][2]) if i in cuts and cuts[i][1] else t for i, t in kept.items()}
    clean = {i: t for i, t in after.items() if not brute_hits(t, [(1, item)])[-1]}
    assert {r[0] for r in got} == set(clean) and sum(i in clean for i in range(300, 304)) == 4 and 400 not in clean and {401, 402, 403} <= set(clean)
    for i, n, ids_sha, text_sha in got:
        if not (i in cuts and cuts[i][1]):
            ids = library.encode(clean[i] or "", add_special_tokens=False).ids
            assert (n, ids_sha, text_sha) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((clean[i] or "").encode()).hexdigest())
        else:
            assert n < len(library.encode(kept[i], add_special_tokens=False).ids) - 60


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    assert p.run(spark, corpus(spark, tmp_path, [], [], [])).count() == 0


def test_encoding_takes_little_memory():
    """Steps of 4 MB took 491 MB of a worker before the library, steps of 1 MB 260 MB."""
    import tracemalloc

    path = bpe.tokenizer_path()
    texts = [" ".join(f"word{(k * 7919 + j * 104729) % 5000} of" for j in range(4000)).encode() for k in range(160)]
    assert sum(map(len, texts)) > 7_000_000
    whole = bpe.ids_of(texts[:3], path, library=True, kind="<u2", tail=b"\0\0")
    tracemalloc.start()
    try:
        found = bpe.ids_of(texts, path, library=True, kind="<u2", tail=b"\0\0")
        assert tracemalloc.get_traced_memory()[1] < 150_000_000
    finally:
        tracemalloc.stop()
    assert found[:3] == whole and all(x.endswith(b"\0\0") for x in found)


def test_distinct_chunks_are_those_of_unique():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 1000, 50_000):
        h = r.integers(0, n // 3 + 2, n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for mine, numpys in zip(bpe._distinct(h), np.unique(h, return_index=True, return_inverse=True)):
            assert (mine == numpys).all()
