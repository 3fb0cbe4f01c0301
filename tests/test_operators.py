"""Folds, joins and the translation of batches."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafwork.functions import replies as R
from leafwork.operators import glossary, grouping, layout, regions, translate
from leafwork.plans import document as D
from leafwork.plans import sessions as S
from leafwork.sources import external


def independent_packing(sizes, blocks=36, chars=8000):
    limit, out, batch, n, size = max(760, min(980, int(chars * 0.3))), [], 0, 0, 0
    for s in sizes:
        if s >= limit:
            batch, n, size = batch + 1, 0, 0
        elif n == 0 or n >= blocks or size + s > chars:
            batch, n, size = batch + 1, 1, s
        else:
            n, size = n + 1, size + s
        out.append(batch)
    return out


@pytest.mark.parametrize("sizes", [[1] * 80, [979, 980, 979], [4000] * 3, [900] * 20, [800] * 10 + [1000] + [1] * 5, [0, 0], [8000, 1]])
def test_packing(spark, sizes):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "doc_id int, k int, chars int")
    got = [r["batch"] for r in grouping.pack(df, ["doc_id"], ["k"], "chars").orderBy("k").collect()]
    assert got == independent_packing(sizes)


def block(k, y0, text, x0=100.0, h=16.0):
    return (1, 1, k, x0, float(y0), x0 + 400, float(y0) + h, text, 12.0)


BLOCK = "doc_id long, page_no int, block_index int, x0 double, y0 double, x1 double, y1 double, text string, base_font_size double"


def merged(spark, rows):
    return [tuple(r) for r in grouping.merge_fragments(spark.createDataFrame(rows, BLOCK), 1360.0).orderBy("block_index").select("block_index", "text", "n_parts").collect()]


def test_merging(spark):
    rows = [block(0, 100, "frag-"), block(1, 120, "tured one"), block(2, 140, "and two"), block(3, 160, "and three")]
    assert merged(spark, rows) == [(0, "fragtured one\nand two", 3), (3, "and three", 1)]


@pytest.mark.parametrize(("gap", "n"), [(10.0, 1), (18.08, 1), (18.09, 2), (-2.5, 1), (-2.6, 2)])
def test_gap_limits(spark, gap, n):
    """The greatest gap is 0.38 x 16 + 12; overlaps need a continuation, which a capital isn't; words that start like Roman numbers look like headings."""
    assert len(merged(spark, [block(0, 100, "Some words"), block(1, 116 + gap, "Take words")])) == n


def test_merging_keeps_columns_apart_and_headings(spark):
    assert len(merged(spark, [block(0, 100, "left words"), block(1, 120, "right words", 800.0)])) == 2
    assert len(merged(spark, [block(0, 100, "II. RELATED WORK"), block(1, 120, "more words")])) == 2


def rects(spark, rows):
    return spark.createDataFrame([(1, 1, *map(float, r)) for r in rows], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")


def test_pages_without_regions(spark):
    b = rects(spark, [(0, 0, 10, 10)]).withColumn("block_index", F.lit(0))
    assert [tuple(r)[3:] for r in regions.max_coverage(b, rects(spark, []), ["doc_id", "page_no", "block_index"]).collect()] == [(0.0, False)]


def test_suppression_is_idempotent(spark):
    df = rects(spark, [(0, 0, 100, 100), (0, 0, 100, 88), (0, 0, 100, 87), (300, 0, 400, 100)])
    once = regions.deduplicate(df, 0.88, ["doc_id", "page_no"])
    assert sorted(r.y1 for r in once.collect()) == [87.0, 100.0, 100.0] or once.count() == 3
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, regions.deduplicate(once, 0.88, ["doc_id", "page_no"]).collect()))


def test_exclusion_bands(spark):
    df = spark.createDataFrame([(True, 0.5199, False), (True, 0.52, False), (True, 0.52, True), (True, 0.82, True), (False, 0.9, False)], "i boolean, c double, n boolean")
    assert [r.x for r in df.select(regions.excluded(F.col("i"), F.col("c"), F.col("n")).alias("x")).collect()] == [False, True, False, True, False]


def test_rule_bands_and_algorithms(spark):
    lines = rects(spark, [(100, 200, 600, 200), (100, 201, 600, 201), (100, 400, 600, 400), (700, 300, 720, 300)])
    bands = regions.rule_bands(regions.rule_lines(lines, F.lit(1360.0)), 1360.0)
    assert bands.count() == 1
    heads = rects(spark, [(120, 210, 300, 230)])
    assert regions.algorithm_regions(bands, heads).count() == 1
    assert regions.algorithm_regions(bands, rects(spark, [(120, 380, 300, 390)])).count() == 0


def test_caption_regions(spark):
    rows = [(1, 1, k, 100.0, y, 500.0, y + 20, *f) for k, (y, f) in enumerate([(100.0, (True, False, False, False)), (130.0, (False, False, False, True)), (160.0, (False, False, False, True)), (190.0, (False, True, False, False)), (220.0, (False, False, False, True))])]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, block_index int, x0 double, y0 double, x1 double, y1 double, caption boolean, note boolean, paragraph boolean, body boolean")
    assert [tuple(r)[2:] for r in regions.caption_regions(df).collect()] == [(98.0, 98.0, 502.0, 182.0)]


def test_references(spark):
    rows = [(1, 1, k, 50.0 * k, 50.0 * k + 40, False, k >= 4, False) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, block_index int, y0 double, y1 double, heading boolean, entry boolean, contributions boolean")
    assert [r.start_y for r in regions.references_start(df).collect()] == [200.0]
    assert regions.references_start(df.withColumn("contributions", F.col("block_index") == 5)).count() == 0
    headed = df.withColumn("heading", F.col("block_index") == 2)
    assert [r.start_y for r in regions.references_start(headed).collect()] == [100.0]


def test_reference_decision(spark):
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 3)] + [(2, 1)], "doc_id long, page_no int")
    anchors = spark.createDataFrame([(1, 2, 700.0)], "doc_id long, anchor_page int, anchor_y double")
    starts = spark.createDataFrame([(1, 1, 900.0), (2, 1, 900.0)], "doc_id long, page_no int, start_y double")
    got = {(r.doc_id, r.page_no): (r.reference_mode, r.start_y) for r in regions.reference_decision(pages, anchors, starts, pages, 1760.0).collect()}
    assert got == {(1, 1): (False, 900.0), (1, 2): (True, 700.0), (1, 3): (True, 0.0), (2, 1): (True, 900.0)}


# Replies --------------------------------------------------------------------------------------------------------------


def test_protection_round_trips():
    for text in ["let \\q = x and \\sum_{i} a_i", "x = y + 1 ≤ z", "plain", "a \\alpha b = c"]:
        hidden, found = R.protect(text)
        assert R.restore(hidden, found) == text
    assert "MATHSEG" in R.protect("x = 1")[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"translations": ["a", "b"]}', ["a", "b"]),
        ('```json\n["a", "b"]\n```', ["a", "b"]),
        ("[1] a\n[2] b", ["a", "b"]),
        ("[2] b\n[1] a\n[7] c", ["a", "b"]),
        ("a\n\nb", ["a", "b"]),
        ("a\nb", ["a", "b"]),
        ('["a", " "]', ["a", "S2"]),
        ("[1] a\n[1] b", ["[1] a", "[1] b"]),
    ],
)
def test_reply_ladder(raw, want):
    assert R.parse(raw, ["S1", "S2"]) == want


@pytest.mark.parametrize("raw", ["a\nb\nc", '["a"]', ""])
def test_bad_replies(raw):
    with pytest.raises(R.ReplyError):
        R.parse(raw, ["S1", "S2"])


def test_failover_and_splitting():
    o = translate.Options()
    bad, good = translate.Stub("bad", [None]), translate.Stub("good")
    out, used, left = translate.ask(["one text here"], [bad, good], o)
    assert used == "good" and left == "bad" and out[0].startswith("译")
    halves = translate.Stub("p", [None, "[1] 甲\n[2] 乙", "[1] 丙\n[2] 丁"])
    assert translate.ask_split(list("abcd"), [halves], o)[0] == ["甲", "乙", "丙", "丁"]
    with pytest.raises(R.ReplyError):
        translate.ask_split(list("abcd"), [translate.Stub("p", [None])], o)
    echo = translate.Stub("e", ["a sentence of words"])
    with pytest.raises(R.ReplyError):
        translate.ask(["a sentence of words"], [echo], o)


def test_compatible_options():
    o = translate.Options.compatible()
    assert (o.max_blocks, o.max_chars, o.single_fallback) == (18, 3600, True)


def _store(tmp_path, spark):
    def store(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return store


def test_translation(spark, tmp_path):
    long_ = "The servers compute the sum of all private inputs without learning any of them"
    rows = [(1, 1, 0, long_), (1, 2, 0, long_), (1, 1, 1, "Every party sends its shares to all of the other parties"), (1, 1, 2, "for example")]
    blocks = spark.createDataFrame(rows, "doc_id long, page_no int, block_index int, text string")
    memory = spark.createDataFrame([], "doc_id long, fp string, translation string")
    out = translate.translate(blocks, memory, [translate.Stub()], translate.Options(), _store(tmp_path / "a", spark))
    got = {(r.page_no, r.block_index): (r.translation, r.source_of) for r in out["translations"].collect()}
    assert len(got) == 4 and got[1, 0] == got[2, 0] and got[1, 0][1] == "batch"
    assert out["memory"].count() == 3 and out["switches"].count() == 0
    again = translate.translate(blocks, out["memory"], [translate.Stub("x", [None])], translate.Options(), _store(tmp_path / "b", spark))
    assert {r.source_of for r in again["translations"].collect()} == {"memory"}
    failed = translate.translate(blocks, memory, [translate.Stub("x", [None])], translate.Options(), _store(tmp_path / "c", spark))
    assert {(r.source_of) for r in failed["translations"].collect()} == {"original", "phrase"}
    assert {r.reason for r in failed["untranslated"].collect()} == {"batch_translation_failed_keep_original"}


def test_document_flow(spark, tmp_path):
    from leafwork.sources.blocks import from_documents, regions_for

    docs = spark.createDataFrame([(1, "The servers compute the sum of all private inputs, and nobody learns any of them.\nReferences\n[1] Smith, J. et al. IEEE vol. 3, 2019"), (2, ""), (3, "x = 1")], "doc_id long, text string")
    b = from_documents(docs)
    memory = spark.createDataFrame([], "doc_id long, fp string, translation string")
    out = D.run(b, regions_for(b).limit(0), memory, [translate.Stub()], translate.Options(), _store(tmp_path, spark))
    reasons = {(r.doc_id, r.block_index): r.skip_reason for r in out["admission"].collect()}
    assert reasons == {(1, 0): None, (1, 1): "below_references_anchor", (1, 2): "below_references_anchor", (3, 0): "should_translate_false"}
    assert out["jobs"].count() == out["translations"].count() == 1


# Layout, glossary, sessions -------------------------------------------------------------------------------------------


def test_wrapping_and_fitting():
    assert layout.wrap("abcd", 10.0, 10.0) == ["ab", "cd"] and layout.wrap("译译", 10.0, 5.0) == ["译", "译"]
    f = layout.fit("译" * 10, 100.0, 30.0, 12.0, layout.Tier(0.5, 6.0, 1.0))
    assert f is not None and f.height <= 30.0 and len(f.lines) == 2
    assert layout.fit("译" * 1000, 100.0, 30.0, 12.0, layout.Tier(0.5, 6.0, 1.0)) is None
    box = {"x0": 0.0, "y0": 0.0, "x1": 300.0, "y1": 60.0, "base_font_size": 20.0, "short": False}
    assert layout.placed(box, "译" * 8, "")[0] == "rendered" and layout.placed(box, "译" * 800, "")[0] == "text_overflow_after_wrap"
    assert layout.folded("𝑥²") == "x2"


def test_glossary(spark):
    df = spark.createDataFrame([(1, "AB AB CD: ef GPUs A ABCDEFGHI x1AB")], "doc_id long, text string")
    assert [tuple(r) for r in glossary.top_terms(df).collect()] == [("AB", 2), ("CD", 1), ("GPUs", 1)]
    terms = spark.createDataFrame([(1, k, t) for k, t in enumerate(["AB: a b", "ab", "x" * 37, "Y" * 40, *(f"T{i}" for i in range(9))])], "doc_id int, k int, term string")
    assert glossary.compacted(terms, ["doc_id"], "k").first()["glossary"] == ", ".join(["AB", "Y" * 40, *(f"T{i}" for i in range(6))])


def test_sessions(spark):
    requests = spark.sql("SELECT 's' AS session_id, 4 AS page_count, timestamp'2024-01-01 00:00:00' AS created_at")
    sessions, pages = S.create(requests)
    assert pages.count() == 4 and sessions.first()["expires_at"].hour == 2
    at = lambda t: S.expiry(sessions, F.lit(t).cast("timestamp")).first()["state"]
    assert [at(f"2024-01-01 {t}") for t in ("01:54:59", "01:55:00", "02:00:00")] == ["live", "expiring", "expired"]
    assert S.swept(sessions, F.lit("2024-01-01 02:02:00").cast("timestamp")).count() == 0
    assert S.swept(sessions, F.lit("2024-01-01 02:01:59").cast("timestamp")).first()["overall_status"] == "expired"
    queued = S.to_enqueue(pages, pages, pages.filter("page_no = 2"))
    assert {r.page_no: r.queue for r in queued.collect()} == {1: "page_high", 3: "page_high", 4: "page_normal"}


def test_latest_keeps_warnings(spark):
    df = spark.sql("SELECT * FROM VALUES ('s', 1, 'failed', array('w'), 'e', 1), ('s', 1, 'pending', CAST(NULL AS array<string>), CAST(NULL AS string), 2) t(session_id, page_no, status, warnings, error, updated_at)")
    assert tuple(S.latest_pages(df, ["updated_at"]).first())[2:5] == ("pending", ["w"], None)


def test_tei(spark):
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><biblStruct coords="1,10,20,100,30"/><biblStruct/></TEI>'
    df = spark.createDataFrame([(1, tei)], "doc_id long, tei string")
    assert regions.grobid_regions(external.tei_coordinates(df)).count() == 1


@pytest.mark.parametrize(
    ("source", "target", "echo"),
    [
        ("Hello brave world", "hello  brave world", True),
        ("short", "short", False),
        ("The protocol keeps all inputs private", "protocol keeps all inputs", True),
        ("The protocol keeps inputs private while servers compute a sum", "the protocol keeps inputs secret while servers compute sum", True),
        ("The protocol keeps inputs private while servers compute a sum", "nothing here looks like what stood there before at all", False),
        ("The protocol keeps inputs private", "协议保护输入 protocol keeps inputs private", False),
        ("", "x", False),
    ],
)
def test_echo_guard_is_the_gate(spark, source, target, echo):
    from leafwork.functions import quality
    from leafwork.operators import translate

    assert translate.is_echo(source, target) == echo
    df = spark.createDataFrame([(source, target)], "s string, t string")
    assert df.select(quality.echo(F.col("s"), F.col("t"))).first()[0] == echo


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        (r"\(x_{i}\) 与 \[y^{2}\] 及 $z$", "x_i 与 y^2 及 z"),
        (r"\text{max} \operatorname { gcd }", "max gcd"),
        (r"a \oplus b \leq c \in S", "a ⊕ b ≤ c ∈ S"),
        (r"r \leftarrow_{R} Z, s leftarrow_{R}, t", "r ←R Z, s ←R, t"),
        ("x<sup>2</sup> &lt;sub&gt;i&lt;/sub&gt;", "x2 i"),
        ("cost by 至少 3", "cost 至少 3"),
        (r"a \_ b \$5", "a _ b 5"),
    ],
)
def test_artefacts(spark, text, clean):
    from leafwork.functions import quality

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(quality.without_artefacts(F.col("t"))).first()[0] == clean


def test_colours_of_large_ids(spark, tmp_path):
    """doc_ids times 4099 are beyond an int from 523,907 on."""
    ids = [0, 523_906, 523_907, 1_280_001, 1 << 40]
    spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()["block_style"](spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in df.schema][1:] == ["double", "int", "int", "int"]
    expected = {(i, 11.0 if i % 2 == 0 else 9.0 + i % 7, (c := i * 4099) >> 16 & 255, c >> 8 & 255, c & 255) for i in ids}
    assert set(map(tuple, df.collect())) == expected


def test_wrapping_stops_where_text_cannot_fit():
    calls, text = [], "a word and another " * 2000
    model = lambda c, size: calls.append(c) or layout.em_width(c, size)
    block = {"x0": 0.0, "y0": 0.0, "x1": 560.0, "y1": 40.0, "base_font_size": 24.4, "short": False}
    assert layout.placed(block, text, "", model) == ("text_overflow_after_wrap", None, 0.0)
    assert len(calls) < 10_000
    for size, width, most in ((10.0, 100.0, 0), (10.0, 100.0, 3), (9.2, 33.3, 7), (10.0, 1.0, 5)):
        whole = layout.wrap("短文 and " * 20 + "\nx", size, width)
        part = layout.wrap("短文 and " * 20 + "\nx", size, width, most=most)
        assert part == whole[: most + 1] and layout.wrap("短文 and " * 20 + "\nx", size, width, most=len(whole)) == whole


def test_pages_without_captions_stay_in_catalyst(spark):
    """One Python call for each page took a third of the document flow; now only pages with a caption go to Python, many at once."""
    row = lambda d, k, y, **f: (d, 1, k, 80.0, y, 600.0, y + 20.0, *(f.get(n, False) for n in ("caption", "note", "paragraph", "body")))
    rows = [row(1, 0, 10.0, body=True), row(1, 1, 40.0, paragraph=True), row(2, 2, 90.0, body=True), row(2, 0, 10.0, caption=True), row(2, 1, 50.0, body=True), row(2, 3, 130.0, note=True), row(3, 0, 5.0, caption=None)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, block_index int, x0 double, y0 double, x1 double, y1 double, caption boolean, note boolean, paragraph boolean, body boolean")
    out = regions.caption_regions(df)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert list(map(tuple, out.collect())) == [(2, 1, 78.0, 8.0, 602.0, 112.0)]


def test_translations_are_made_without_fitting(spark, data, monkeypatch):
    monkeypatch.setattr(layout, "render", lambda *_: pytest.fail("translate_documents has no use for fitted text"))
    assert entry.queries()["translate_documents"](spark, data).count() > 0


def test_pages_are_merged_by_plain_functions(spark):
    """The same blocks as merge_fragments over joined texts; a text goes through one shuffle, without a join."""
    import random

    r = random.Random(7)
    said = ["the servers compute", "and send it to the next", "values of a sum -", "x = y", "count(x)", "1) one", "II Method", "where", "Every word here is", "a-", "é and", "", " ", "Ünder all of them that", "word " * 20, "state1 next"]
    rows, k = [], 0
    for page in range(60):
        y = 50.0
        for _ in range(r.randint(1, 30)):
            h, x0 = r.choice([14.0, 14.0, 46.0, 80.0]), r.choice([80.0, 80.0, 84.0, 720.0])
            rows.append((page // 3, page, k, x0, y, x0 + r.choice([500.0, 500.0, 490.0, 300.0]), y + h, r.choice(said) + r.choice(["", "", "-", ",", "."]), r.choice([11.0, 14.0])))
            k, y = k + 1, y + h + r.choice([-20.0, -3.0, 0.0, 5.0, 9.0, 25.0, 60.0])
    df = spark.createDataFrame(rows, BLOCK)
    some = df.filter("block_index % 11 <> 0")
    done = grouping.merged_pages(some.drop("text"), df.select("doc_id", "page_no", "block_index", "text"), 1360.0)
    assert "Join" not in done._jdf.queryExecution().optimizedPlan().toString()
    columns = ["doc_id", "page_no", "block_index", "x0", "y0", "x1", "y1", "width", "height", "base_font_size", "n_parts", "text"]
    want = sorted(map(tuple, grouping.merge_fragments(some, 1360.0).select(columns).collect()))
    assert sorted(map(tuple, done.select(columns).collect())) == want and any(x[10] == 3 for x in want)


@pytest.mark.parametrize("sizes", [[1] * 80, [979, 980, 979], [4000] * 3, [900] * 20, [800] * 10 + [1000] + [1] * 5, [0, 0], [8000, 1]])
def test_packing_of_a_page(sizes):
    assert grouping.packed(sizes) == independent_packing(sizes)


def test_flow_stores_a_text_once(spark, tmp_path):
    from leafwork.sources.blocks import from_documents, regions_for

    stored = {}

    def store(df, name):
        stored[name] = df.columns
        return _store(tmp_path, spark)(df, name)

    b = from_documents(spark.createDataFrame([(1, "Every server keeps its values private and sends sums only.\nNobody else learns anything of them at all.")], "doc_id long, text string"))
    out = D.run(b, regions_for(b).limit(0), spark.createDataFrame([], "doc_id long, fp string, translation string"), [translate.Stub()], translate.Options(), store)
    assert out["fitted"].count() == out["jobs"].count() > 0
    assert "text" not in stored["flags"] and "texts" not in stored["replies"] and "prompts" not in stored and "lookup" not in stored
    assert spark.read.parquet(str(tmp_path / "jobs")).filter("prompt = text").count() == 0 and spark.read.parquet(str(tmp_path / "replies")).filter("text is not null").count() == 0


def test_text_that_cannot_fit_is_not_wrapped(monkeypatch):
    """Sizes at which full lines don't hold the text are passed over; what is left fits as with a model of unknown widths."""
    tried, wrap = [], layout.wrap
    monkeypatch.setattr(layout, "wrap", lambda *a: tried.append(a[1]) or wrap(*a))
    slow = lambda c, size: layout.em_width(c, size)
    for n, width, height in [(10, 200.0, 30.0), (60, 300.0, 60.0), (110, 560.0, 68.0), (400, 560.0, 68.0), (7, 30.0, 200.0)]:
        for tier in layout.TIERS:
            text = "译a" * n
            tried.clear()
            found = layout.fit(text, width, height, 24.4, tier)
            assert len(tried) <= 5
            assert found == layout.fit(text, width, height, 24.4, tier, slow)
