"""Predicates, gates and text functions at both sides of their thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from leafwork.functions import geometry as G
from leafwork.functions import predicates as is_
from leafwork.functions import quality as Q
from leafwork.functions.text import clean_extracted, compact, truncated, view

WORDY = "The protocol keeps inputs private while servers compute a sum of many values together"


def value(spark, make, *texts):
    names = "abcdef"[: len(texts)]
    df = spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names))
    return df.select(make(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "n"),
    [("a-b", 0), ("and/or", 0), ("x - y", 1), ("3-4", 1), ("x=1", 1), ("a≤b", 1), ("-", 1), ("a-=b", 2), ("privacy-preserving", 0), ("", 0)],
)
def test_math_symbols(spark, text, n):
    assert value(spark, is_.math_symbols, text) == n


@pytest.mark.parametrize(
    ("predicate", "text", "want"),
    [
        (is_.skipped, "", True),
        (is_.skipped, "12.5 (3)", True),
        (is_.skipped, "see https://example.org/x", True),
        (is_.skipped, "[3, 4]", True),
        (is_.skipped, WORDY + ".", False),
        (is_.skipped, "x = y + 1", True),
        (is_.skipped, "where p <= 0.05", False),
        (is_.skipped, "def f(x); return", True),
        (is_.standalone_caption, "Table 3", True),
        (is_.standalone_caption, "Table V lists the accuracy of every method we tried here", False),
        (is_.standalone_caption, "Figure 2 shows", True),
        (is_.licence_watermark, "Authorized licensed use limited to: A University.", True),
        (is_.licence_watermark, "Downloaded on May 1 from IEEE Xplore.", True),
        (is_.licence_watermark, "restrictions apply", False),
        (is_.reference_heading, "7. References:", True),
        (is_.reference_heading, "A reference to it", False),
        (is_.reference_entry, "[3] Smith, J. et al. A scheme. IEEE Trans., vol. 3, 2019.", True),
        (is_.reference_entry, "[3] Our contributions: we propose a scheme in 2019", False),
        (is_.algorithm_block, "Algorithm 1\nInput: x\n1) if x then y", True),
        (is_.algorithm_block, WORDY, False),
        (is_.numbered_narrative_list, "Our contributions are these\n1) We propose a new scheme for sums of values\n2) We study its cost in rounds and bytes sent", True),
        (is_.table_caption, "TABLE II: accuracy", True),
        (is_.table_caption, "TABLE II lists what each of these methods needs", False),
        (is_.table_header, "method accuracy recall", True),
        (is_.table_body, "svm 0.91 0.88 0.90", True),
        (is_.table_like, "svm 0.91 0.88 0.90\nknn 0.81 0.78 0.80", True),
        (is_.paragraph_block, WORDY + ".", True),
        (is_.paragraph_block, "short.", False),
        (is_.title_block, "Private Sums of Many Values Among Distrusting Servers", True),
        (is_.title_block, "Private sums", False),
        (is_.formula_block, "x = y + 1\nz = x * 2", True),
        (is_.narrative_prose, "Theorem 1. Every honest server learns the sum", True),
    ],
)
def test_predicates(spark, predicate, text, want):
    assert value(spark, lambda c: predicate(view(c)), text) is want


def test_header_and_footer_limits(spark):
    ask = lambda y0, y1: value(spark, lambda c: is_.running_header_footer(view(c), F.lit(y0), F.lit(y1), F.lit(1000.0)), "17")
    assert ask(80.0, 95.0) and not ask(80.0, 95.1) and ask(900.0, 950.0) and not ask(899.9, 950.0)


def test_multi_line_text_looks_like_code_once_compacted(spark):
    """Semicolons take the newlines' place, so a short block of several lines is skipped."""
    assert value(spark, lambda c: compact(c), "one two\nthree four") == "one two ; three four"
    assert value(spark, lambda c: is_.translatable(view(compact(c))), "one two\nthree four") is False


def test_clean(spark):
    assert value(spark, lambda c: clean_extracted(c), "\x01 A\u2212b,c\n\n\n\nx\u25a1 ﬁ ") == "A-b, c\n\nx fi"


def test_truncated(spark):
    cut = lambda n: value(spark, lambda c: truncated(c, F.lit(n)), "一二三。四五六。七八")
    assert cut(4) == "一二三。" and cut(8) == "一二三。四五六。" and cut(2) == "一二三。" and cut(50) == "一二三。四五六。七八"
    assert value(spark, lambda c: truncated(c, F.lit(3)), "ab, cd") == "ab, cd", "a first sentence stays whole"


def judged(spark, source, target, **more):
    df = spark.createDataFrame([(source, target)], "source string, target string")
    return Q.judge(df, "source", "target", **more).first()["low_quality"]


@pytest.mark.parametrize(
    ("source", "target", "bad"),
    [
        (WORDY, WORDY, True),
        (WORDY, "", True),
        (WORDY, None, True),
        ("", "x", False),
        (WORDY, "该协议在多台服务器共同计算许多数值之和时对输入保密", False),
        (WORDY, "terms=该协议在多台服务器共同计算之和", True),
        (WORDY, "译" * 400, True),
        ("one", "一", False),
    ],
)
def test_low_quality(spark, source, target, bad):
    assert judged(spark, source, target) is bad


def test_residue_needs_lines(spark):
    target = "该协议对输入保密。\nThe protocol keeps inputs private while servers compute"
    assert judged(spark, WORDY, target, strict_lines=True) is True


def test_normalise(spark):
    df = spark.createDataFrame([(WORDY, "译文：$x$ 与 \\alpha\n（翻译要求：不要输出）该协议"), ("Section IV. Related Work", "IV."), ("a b", "")], "s string, t string")
    out = [r["normalised"] for r in Q.normalise(df, "s", "t").collect()]
    assert out[0].startswith("x 与 alpha") and "翻译要求" not in out[0]
    assert out[1] == "IV. 相关工作" and out[2] == ""


def test_items(spark):
    assert value(spark, Q.trimmed_items, "1) keep this one", "1) 保留这一项吧好的；2) 多余的一项") == "1) 保留这一项吧好的"
    assert value(spark, lambda a: Q.item_positions(a), "x; 1) a; 22) b") == [3, 9]


def test_rectangles(spark):
    def rect(*v):
        return G.Rect(*(F.lit(float(x)) for x in v))

    df = spark.range(1)
    a = rect(0, 0, 100, 100)
    got = df.select(
        G.iou(a, rect(0, 0, 100, 100)).alias("same"), G.iou(a, rect(100, 0, 200, 100)).alias("edge"), G.touches(a, rect(100, 0, 200, 100)).alias("touch"),
        G.significant(a, rect(0, 0, 18, 100)).alias("at"), G.significant(a, rect(0, 0, 17.9, 100)).alias("below"), G.significant(a, rect(0, 0, 62, 18)).alias("wide"),
        G.significant(a, rect(0, 0, 61.9, 18)).alias("narrow"), G.coverage(rect(5, 5, 5, 5), a).alias("empty"), G.rgb(F.lit(0x102030)).alias("rgb"),
    ).first()
    assert (got.same, got.edge, got.touch, got.at, got.below, got.wide, got.narrow, got.empty) == (1.0, 0.0, True, True, False, True, False, 0.0)
    assert tuple(got.rgb) == (16, 32, 48)


def test_normalising_is_done_by_plain_functions(spark):
    """The same texts as by Column expressions, whose lambdas over lines took most of the time; none is left in the plan."""
    parts = [
        "译文：", "\\(x+1\\)", "$a=b$", "\\leftarrow", "leftarrow _ {R", "\\times ", "\\text{ab}", "x_{12}", "</sup>", "&lt;sub&gt;", "$ ", "\\", "value by 3", "x by at least", "=; a", "  ", "\n", "\x85", "\x1c", "\u3000", "…", "..",
        "(continued above)", "续上行", "terms=", "（不要翻译）", "(strict retry mode abc)", "mathseg12token", "+ abc，", "- (x", "=", "1) ", "、3、", ", 2) ", "。", "；", ";", "The protocol keeps inputs private while servers compute", "IEEE", "译文服务器",
        "文" * 30, "Section IV. ", "IV. Related Work", " for the", " and the", "é", "\u0301", "ſ", "İ", "ı", "²", "①", "‴", "′", "−", "Â", "a□b", "≤x", "http://a.b/c?d=e&f", "word ", "：", "'", "f' s(x)", "Ⓐ", "\x07", "ΑΣ", "vii.",
    ]
    r = random.Random(5)
    text = lambda most: "".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, most)))
    pairs = [(s := text(r.choice([2, 6, 20])), r.choice([s, text(6), text(25), s + "\n" + text(6), s + text(4), text(3) + "\n" + "服务器共同计算。" * r.randint(0, 12) + s])) for _ in range(1500)]
    pairs += [(None, "1) abcdefgh 2) b"), ("a", None), (None, None), ("", ""), ("…", "……")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s string, t string")
    for rules in (None, [("^Section IV", "第四节"), ("(?i)related work", "")]):
        done = Q.normalise(df, "s", "t", rules=rules)
        plan = done._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan or "_normalised" in plan
        assert "lambda" not in plan
        slow = {x["i"]: x["normalised"] for x in Q.normalise_by_columns(df, "s", "t", rules=rules).collect()}
        wrong = [(x["s"], x["t"], x["normalised"], slow[x["i"]]) for x in done.collect() if x["normalised"] != slow[x["i"]]]
        assert not wrong and len(slow) == len(pairs)


_PARTS = [
    "TABLE II: accuracy", "Table 3 lists", "[12] Smith, J. et al. ", "IEEE vol. 3, 2019", "Algorithm 1", "Input: x", "1) if x then y", "end for", "x = y + 1", "where x", "a - b / c * d", "f(x, y)", "\\alpha", "https://a.b", "References", "参考文献", "1 2 3", "4.5 6 7 8",
    "accuracy 3 ✓ x", "method baseline recall f1", "notation definition", "theorem 1. the ", "we propose our ", "contribution", "- one two three four five six seven", "1. we compute the sum of all values", "return state12", "count (x)", "a[1]", ":=", "next", "min",
    "The protocol keeps inputs private while servers compute a sum of many values together.", "Note: ", "(see 2019)", "downloaded on ieee xplore", "restrictions apply", "authorized licensed use limited to", "§", "一二三四五六七八", "译" * 20, "é", "́", "ſend", "K", "İf", "ı", "²", "①",
    "Ⓐ", "𝐱", "‍", "٣", "\x1c", "\x85", "　", "\t", "  ", "\n", "\n", "\n", "-\n", ";", "; ;", ",", ". ", "?", ":", "$x$", "{", "|", "for example", "that which", "computes", "ciphertext", "12", "Jones et al.:", "doi", "Downloaded", "the", "Choose", "subject to", "s.t.x", "A", "ΑΣ",
]


def _texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [*_PARTS, "", *("".join(r.choice(_PARTS) + r.choice(["", " ", " ", "\n"]) for _ in range(r.choice([1, 2, 4, 9, 20, 40]))) for _ in range(n))]


def test_flags_are_made_by_plain_functions(spark):
    """The same flags as by Column expressions, whose lambdas over lines took most of the time of the document flow."""
    from leafwork.plans import document as D

    r = random.Random(3)
    rows = [(1, k // 40, k, 0.0, y := r.choice([10.0, 150.0, 900.0, 1590.0, 1700.0]), 100.0, y + 14, t, 11.0) for k, t in enumerate([None, *_texts(1500, 3)])]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, block_index int, x0 double, y0 double, x1 double, y1 double, text string, font_size double")
    done = D.flagged(df)
    assert "lambda" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in D.flagged(df, text=False).columns
    slow = {x["block_index"]: x.asDict() for x in D.flagged_by_columns(df).collect()}
    got = [x.asDict() for x in done.collect()]
    wrong = [(x["text"], n, x[n], slow[x["block_index"]][n]) for x in got for n in x if x[n] != slow[x["block_index"]][n]]
    assert not wrong and len(got) == len(rows) == len(slow)


def test_gates_and_set_text_are_made_by_plain_functions(spark):
    from leafwork.functions import plain_predicates as plain
    from leafwork.functions.text import collapse, keeps_lines, item_count, words
    from leafwork.operators import layout

    r, texts = random.Random(4), _texts(800, 4)
    said = ["译" * 90, "服务器共同计算。" * 12, "1) 甲 2) 乙 3) 丙。", "terms=甲乙丙丁", "（不要翻译）", "'甲\n‘乙  丙", "续上行\n甲", "5. 结论"]
    pairs = [(s, r.choice([s, r.choice(texts), r.choice(said), r.choice(said) + s, None, "译" * r.randint(0, 200)])) for s in texts]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, s string, t string")
    df = Q.judge(df, "s", "t", "bad").withColumns({"c": compact(F.col("s")), "keeps": keeps_lines(view(F.col("s"))), "n": F.length(collapse(F.col("s"))), "w": words(collapse(F.col("s"))), "i": item_count(collapse(F.col("s")))})
    df = Q.tight_box(df.withColumn("set", layout.render_text(F.col("s"), F.col("t"))), "s", "set", F.lit(30.0), F.lit(200.0), "tight")
    wrong = []
    for x in df.collect():
        keeps, n, w, i, _ = plain.facts(x["s"])
        own = None if x["t"] is None else plain.set_text(x["t"], keeps)
        tight = None if own is None else plain.tight_box(n, w, i, own, 30.0, 200.0)
        got = (plain.low_quality(x["s"], x["t"]), plain.compact(x["s"]), keeps, n, w, i, own, tight)
        want = tuple(x[c] for c in ("bad", "c", "keeps", "n", "w", "i", "set", "tight"))
        if got != want:
            wrong.append((x["s"], x["t"], got, want))
    assert not wrong
