"""The registered queries: each operator over whole tables, and the SQL that must give the same rows where SQL can say it.

Inputs beyond the tables are computed from them: blocks from lines of documents, regions from pages, page states from events,
translations and labelled texts from first lines by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import predicates as is_
from ..functions import quality as Q
from ..functions.geometry import Rect
from ..functions.text import cjk, collapse, fingerprint, first_sentence, item_count, item_positions, label, strip_fence, style, truncated, view, with_known, with_view, words
from ..operators import glossary, grouping, layout, regions, translate
from ..sources import blocks as B
from ..sources import external as X
from . import document as D
from . import sessions as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# SQL pieces -----------------------------------------------------------------------------------------------------------


def s_words(x: str) -> str:
    return f"len(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{3,}}')))"


def s_cjk(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[一-鿿]'))"


def s_flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def s_marks(x: str, marks: str) -> str:
    return f"(length({x}) - length(translate({x}, '{marks}', '')))"


S_BLOCKS = """
lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
cut AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no FROM lines),
blocks AS (
  SELECT doc_id, (line_no // 40 + 1)::INTEGER AS page_no, line_no::INTEGER AS block_index, (80 + 640 * ((line_no % 40) // 20))::DOUBLE AS x0, (60 + 82 * ((line_no % 40) % 20))::DOUBLE AS y0,
         (80 + 640 * ((line_no % 40) // 20) + least(560, 6 * length(text)))::DOUBLE AS x1, (60 + 82 * ((line_no % 40) % 20) + 14 + 18 * (length(text) // 90))::DOUBLE AS y1, text
  FROM cut WHERE trim(text) <> ''
)"""
S_REGIONS = """
regions AS (
  SELECT doc_id, page_no, k, (60 + 200 * (k % 3) + d)::DOUBLE AS x0, (100 + 300 * (k % 3) + 7 * (doc_id % 10))::DOUBLE AS y0,
         (60 + 200 * (k % 3) + d + 400)::DOUBLE AS x1, (100 + 300 * (k % 3) + 7 * (doc_id % 10) + 150)::DOUBLE AS y1
  FROM (SELECT doc_id, page_no, k, CASE WHEN k = 3 THEN 10 * (doc_id % 5) ELSE 0 END AS d FROM (SELECT DISTINCT doc_id, page_no FROM blocks), range(4) AS r(k))
)"""
S_INTER = "greatest(0.0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0.0, least(b.y1, r.y1) - greatest(b.y0, r.y0))"
S_PAGES = """
changes AS (
  SELECT user_id::VARCHAR AS session_id, (json_extract(props, '$.k')::INTEGER % 10 + 1)::INTEGER AS page_no, ts, event_id,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ready' ELSE 'processing' END AS status, CASE WHEN event_type = 'error' THEN ['w' || (event_id % 3)] END AS warnings
  FROM events
),
states AS (
  SELECT session_id, page_no, arg_max(status, (ts, event_id)) AS status, coalesce(arg_max(warnings, (ts, event_id)) FILTER (warnings IS NOT NULL), []) AS warnings FROM changes GROUP BY ALL
)"""
S_PAIRS = (
    S_BLOCKS
    + """,
pairs AS (
  SELECT doc_id, block_index, text AS source, CASE (doc_id + block_index) % 6 WHEN 0 THEN text WHEN 1 THEN repeat('译', 20) WHEN 2 THEN '' WHEN 3 THEN text || chr(10) || repeat('文', 12) WHEN 4 THEN 'terms=' || text ELSE repeat('长', 400) END AS translated FROM blocks
)"""
)
S_LABELLED = (
    S_BLOCKS
    + """,
labelled AS (
  SELECT doc_id, block_index, CASE (doc_id + block_index) % 8 WHEN 0 THEN text WHEN 1 THEN 'Table ' || doc_id || ' lists ' || text WHEN 2 THEN 'TABLE ' || doc_id WHEN 3 THEN '[' || (doc_id % 90) || '] Smith, J. et al. IEEE vol. 3, 2019'
         WHEN 4 THEN 'Algorithm 1' || chr(10) || 'Input: x' || chr(10) || '1) if x then y' WHEN 5 THEN 'x = ' || doc_id WHEN 6 THEN 'https://example.org/' || doc_id ELSE 'References' END AS text, (doc_id + block_index) % 8 AS kind FROM blocks
)"""
)
S_ECHO = f"""v AS (SELECT doc_id, block_index, lower({s_flat('source')}) AS s, lower({s_flat('translated')}) AS t, len(regexp_extract_all({s_flat('source')}, '[A-Za-z]')) AS latin FROM pairs),
    c AS (SELECT *, {s_words('s')} AS sw, {s_words('t')} AS tw, {s_cjk('t')} AS zh FROM v),
    e AS (SELECT doc_id, block_index, CASE WHEN s = '' OR t = '' THEN false WHEN s = t THEN latin >= 10 WHEN sw < 3 OR tw < 4 OR zh >= 4 THEN false ELSE contains(s, t) OR contains(t, s) END AS echo FROM c)"""
S_ITEM = "'(?:^|[\\n\\r;；,，。：:\\.]\\s*)(?:[（(]?\\d{1,2}[）)]|\\d{1,2}[\\.、:：])'"

S_LEFT, S_RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
S_BARE = r"r{b}|[A-Za-z]\[[^\]]+\]|count\(|state\d*{b}|next{b}|res{b}".replace("{b}", S_RIGHT)


# Inputs ---------------------------------------------------------------------------------------------------------------


def docs(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.from_documents(docs(spark, d))


def changes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "error", "failed").when(kind == "purchase", "ready").otherwise("processing")
    return B.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), (F.get_json_object("props", "$.k").cast("int") % 10 + 1).alias("page_no"), status.alias("status"),
        F.when(kind == "error", F.array(F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")))).alias("warnings"), F.when(kind == "error", "error").alias("error"), F.col("ts").alias("updated_at"), F.col("event_id").alias("change_id"),
    )


def states(spark: SparkSession, d: str) -> DataFrame:
    out = S.latest_pages(changes(spark, d), ["updated_at", "change_id"])
    return out.withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    first = changes(spark, d).groupBy("session_id").agg(F.min("updated_at").cast("timestamp").alias("created_at"))
    return S.create(first.select("session_id", (F.col("session_id").cast("int") % 12).alias("page_count"), "created_at"))[0]


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every block as a source, with translations of six kinds."""
    s, k = F.col("source"), (F.col("doc_id") + F.col("block_index")) % 6
    target = F.when(k == 0, s).when(k == 1, F.repeat(F.lit("译"), 20)).when(k == 2, "").when(k == 3, F.concat(s, F.lit("\n"), F.repeat(F.lit("文"), 12))).when(k == 4, F.concat(F.lit("terms="), s)).otherwise(F.repeat(F.lit("长"), 400))
    return blocks(spark, d).select("doc_id", "block_index", F.col("text").alias("source")).withColumn("translated", target)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Every block, with its text or one of seven others in its place."""
    i, k, s = F.col("doc_id").cast("string"), (F.col("doc_id") + F.col("block_index")) % 8, F.col("text")
    text = (
        F.when(k == 0, s).when(k == 1, F.concat(F.lit("Table "), i, F.lit(" lists "), s)).when(k == 2, F.concat(F.lit("TABLE "), i))
        .when(k == 3, F.concat(F.lit("["), (F.col("doc_id") % 90).cast("string"), F.lit("] Smith, J. et al. IEEE vol. 3, 2019"))).when(k == 4, F.lit("Algorithm 1\nInput: x\n1) if x then y"))
        .when(k == 5, F.concat(F.lit("x = "), i)).when(k == 6, F.concat(F.lit("https://example.org/"), i)).otherwise("References")
    )
    return blocks(spark, d).select("doc_id", "block_index", text.alias("text"))


KEY = ["doc_id", "block_index"]


# Text -----------------------------------------------------------------------------------------------------------------


@query(
    "glossary_topk",
    "WITH t AS (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS term FROM documents) SELECT term, count(*) AS n FROM t WHERE regexp_full_match(term, '[A-Z]{2,8}s?') GROUP BY 1 ORDER BY n DESC, term LIMIT 12",
)
def _(spark, d):
    return glossary.top_terms(docs(spark, d))


@query(
    "glossary_by_document",
    """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS term FROM documents), n AS (SELECT doc_id, term, count(*) AS n FROM t WHERE regexp_full_match(term, '[A-Z]{2,8}s?') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS k FROM n),
f AS (SELECT doc_id, upper(term) AS u, min(k) AS k, arg_min(term, k) AS term FROM r WHERE k <= 12 GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, u) AS j FROM f)
SELECT doc_id, string_agg(term, ', ' ORDER BY j) AS glossary FROM g WHERE j <= 8 GROUP BY 1""",
)
def _(spark, d):
    from pyspark.sql import Window

    top = glossary.top_terms(docs(spark, d), by=["doc_id"])
    ranked = top.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")))
    return glossary.compacted(ranked, ["doc_id"], "k")


@query(
    "block_counts",
    f"WITH {S_BLOCKS} SELECT doc_id, page_no, count(*) AS n_blocks, sum({s_words('text')})::BIGINT AS n_words, sum({s_cjk('text')})::BIGINT AS n_cjk, sum(length(text))::BIGINT AS n_chars FROM blocks GROUP BY ALL",
)
def _(spark, d):
    return blocks(spark, d).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(words(F.col("text"))).alias("n_words"), F.sum(cjk(F.col("text"))).alias("n_cjk"), F.sum(F.length("text")).alias("n_chars"))


@query(
    "text_scalars",
    f"""WITH {S_PAIRS} SELECT doc_id, block_index, {s_flat('source')} AS flat, lower({s_flat('source')}) AS label, trim(regexp_split_to_array({s_flat('source')}, '[.!?;:]\\s+')[1]) AS first_sentence, sha1(source) AS fp, {s_words('source')}::INTEGER AS n_words,
    {s_marks('source', '.?!;:')}::INTEGER AS n_marks FROM pairs""",
)
def _(spark, d):
    s = F.col("source")
    return pairs(spark, d).select(*KEY, collapse(s).alias("flat"), label(s).alias("label"), first_sentence(collapse(s)).alias("first_sentence"), fingerprint(s).alias("fp"), words(s).cast("int").alias("n_words"), view(s).punct.cast("int").alias("n_marks"))


@query("clean_text")
def _(spark, d):
    from ..functions.text import clean_extracted, compact

    return labelled(spark, d).select(*KEY, clean_extracted(F.col("text")).alias("cleaned"), compact(F.col("text")).alias("compact"))


@query(
    "truncate_sentences",
    """
WITH p AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents),
q AS (SELECT doc_id, x, list_filter(list_transform(regexp_extract_all(x, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ps FROM p)
SELECT doc_id, CASE WHEN length(x) <= 400 THEN x WHEN len(ps) = 0 THEN '' ELSE array_to_string(list_filter(ps, lambda s, i: i = 1 OR list_sum(list_transform(ps[1:i], lambda t: length(t))) <= 400), '') END AS cut FROM q""",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", truncated(F.col("text"), F.lit(400)).alias("cut"))


@query("item_markers", f"WITH {S_LABELLED} SELECT doc_id, block_index, len(regexp_extract_all(text || chr(10) || '1) a; 2) b', {S_ITEM}))::INTEGER AS n_items FROM labelled")
def _(spark, d):
    return labelled(spark, d).select(*KEY, item_count(F.concat("text", F.lit("\n1) a; 2) b"))).cast("int").alias("n_items"))


# Distinct texts and the memory ----------------------------------------------------------------------------------------


@query(
    "fingerprint_dedup",
    f"WITH {S_BLOCKS} SELECT doc_id, sha1(text) AS fp, count(*) AS n, arg_min(page_no, (page_no, block_index)) AS page_no, arg_min(block_index, (page_no, block_index)) AS block_index, any_value(text) AS text FROM blocks GROUP BY doc_id, sha1(text)",
)
def _(spark, d):
    return grouping.distinct_texts(blocks(spark, d), ["doc_id"], "text", ["page_no", "block_index"])


def _memory(spark, d):
    first = docs(spark, d).select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("s"))
    return first.select("doc_id", fingerprint(F.col("s")).alias("fp"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("m"), F.col("doc_id").cast("string"))).alias("translation"), F.lit(1).alias("updated_at"))


S_MEMORY = "memory AS (SELECT doc_id, sha1(string_split(text, chr(10))[1]) AS fp, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'm' || doc_id END AS translation FROM documents)"


@query("memory_hit_join", f"WITH {S_BLOCKS}, {S_MEMORY} SELECT b.doc_id, b.page_no, b.block_index, m.translation FROM blocks b LEFT JOIN memory m ON m.doc_id = b.doc_id AND m.fp = sha1(b.text) AND m.translation <> ''")
def _(spark, d):
    rows = blocks(spark, d).withColumn("fp", fingerprint(F.col("text")))
    return grouping.memory_lookup(rows, _memory(spark, d), ["doc_id"]).select("doc_id", "page_no", "block_index", "translation")


@query(
    "memory_upsert",
    f"WITH {S_MEMORY}, u AS (SELECT doc_id, fp, 'new' AS translation FROM memory WHERE doc_id % 3 = 0) SELECT m.doc_id, m.fp, coalesce(u.translation, m.translation) AS translation, CASE WHEN u.fp IS NULL THEN 1 ELSE 2 END AS updated_at FROM memory m LEFT JOIN u USING (doc_id, fp) WHERE m.doc_id % 5 <> 0",
)
def _(spark, d):
    m = _memory(spark, d)
    new = m.filter("doc_id % 3 = 0").select("doc_id", "fp", F.lit("new").alias("translation"), F.lit(2).alias("updated_at"))
    return grouping.memory_delete(grouping.memory_merge(m, new, ["doc_id"]), m.filter("doc_id % 5 = 0"), ["doc_id"])


# Geometry and regions -------------------------------------------------------------------------------------------------


@query(
    "block_region_overlap",
    f"""WITH {S_BLOCKS}, {S_REGIONS}, j AS (SELECT b.doc_id, b.page_no, b.block_index, {S_INTER} AS i, greatest(1.0, (b.x1 - b.x0) * (b.y1 - b.y0)) AS a, greatest(0.0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) / greatest(1.0, b.x1 - b.x0) AS w,
    greatest(0.0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) AS h, b.y1 - b.y0 AS bh FROM blocks b JOIN regions r USING (doc_id, page_no))
    SELECT doc_id, page_no, block_index, round(max(i / a), 6) AS coverage, bool_or(i > 0 AND (i / a >= 0.18 OR (w >= 0.62 AND h >= greatest(8.0, bh * 0.18)))) AS in_region FROM j GROUP BY ALL""",
)
def _(spark, d):
    b = blocks(spark, d)
    return regions.max_coverage(b, B.regions_for(b), D.BLOCK).withColumn("coverage", F.round("coverage", 6))


@query(
    "block_region_antijoin",
    f"""WITH {S_BLOCKS}, {S_REGIONS}, j AS (SELECT b.doc_id, b.page_no, b.block_index, any_value(b.text) AS text, max({S_INTER} / greatest(1.0, (b.x1 - b.x0) * (b.y1 - b.y0))) AS c FROM blocks b JOIN regions r USING (doc_id, page_no) GROUP BY ALL)
    SELECT doc_id, page_no, block_index FROM j WHERE NOT (c >= 0.52 AND NOT (c < 0.82 AND {s_marks('text', '.?!;')} >= 1 AND {s_words('text')} >= 8))""",
)
def _(spark, d):
    b = blocks(spark, d)
    cover = regions.max_coverage(b, B.regions_for(b), D.BLOCK)
    gone = cover.join(b.select(*D.BLOCK, "text"), D.BLOCK).filter(regions.excluded(F.col("in_region"), F.col("coverage"), is_.paragraph_block(view(F.col("text"))))).select(*D.BLOCK)
    return b.select(*D.BLOCK).join(gone, D.BLOCK, "left_anti")


@query(
    "region_iou_pairs",
    f"""WITH {S_BLOCKS.replace('blocks AS (', 'blocks AS MATERIALIZED (')}, {S_REGIONS.replace('regions AS (', 'regions AS MATERIALIZED (')}, p AS (SELECT b.doc_id, b.page_no, b.k AS a, r.k AS b, {S_INTER} AS i, (b.x1 - b.x0) * (b.y1 - b.y0) AS s, (r.x1 - r.x0) * (r.y1 - r.y0) AS t FROM regions b JOIN regions r ON b.doc_id = r.doc_id AND b.page_no = r.page_no AND b.k < r.k)
    SELECT doc_id, page_no, a::INTEGER AS a, b::INTEGER AS b, round(CASE WHEN i > 0 THEN i / (s + t - i) ELSE 0 END, 6) AS iou FROM p""",
)
def _(spark, d):
    r = B.regions_for(blocks(spark, d))
    other = r.select("doc_id", "page_no", F.col("k").alias("k2"), *(F.col(n).alias(f"r_{n}") for n in regions.RECT))
    both = r.join(other, D.PAGE).filter("k < k2")
    return both.select(*D.PAGE, F.col("k").cast("int").alias("a"), F.col("k2").cast("int").alias("b"), F.round(G.iou(Rect.of(), Rect.of("r_")), 6).alias("iou"))


@query(
    "region_nms",
    f"""WITH RECURSIVE {S_BLOCKS}, {S_REGIONS},
    o AS (SELECT doc_id, page_no, list([x0, y0, x1, y1] ORDER BY y0, x0, y1, x1) AS rs FROM regions GROUP BY ALL),
    f(doc_id, page_no, rs, n, kept) AS (
      SELECT doc_id, page_no, rs, 1, [rs[1]] FROM o UNION ALL
      SELECT doc_id, page_no, rs, n + 1, CASE WHEN len(list_filter(kept, lambda q: (greatest(0, least(rs[n+1][3], q[3]) - greatest(rs[n+1][1], q[1])) * greatest(0, least(rs[n+1][4], q[4]) - greatest(rs[n+1][2], q[2]))) /
        ((rs[n+1][3] - rs[n+1][1]) * (rs[n+1][4] - rs[n+1][2]) + (q[3] - q[1]) * (q[4] - q[2]) - (greatest(0, least(rs[n+1][3], q[3]) - greatest(rs[n+1][1], q[1])) * greatest(0, least(rs[n+1][4], q[4]) - greatest(rs[n+1][2], q[2])))) >= 0.88)) > 0
        THEN kept ELSE list_append(kept, rs[n+1]) END FROM f WHERE n < len(rs))
    SELECT doc_id, page_no, q[1] AS x0, q[2] AS y0, q[3] AS x1, q[4] AS y1 FROM (SELECT doc_id, page_no, unnest(kept) AS q FROM f WHERE n = len(rs))""",
)
def _(spark, d):
    return regions.deduplicate(B.regions_for(blocks(spark, d)), 0.88, D.PAGE)


@query(
    "rule_bands",
)
def _(spark, d):
    b = blocks(spark, d)
    segments = b.select(*D.PAGE, F.col("x0"), F.col("y1").alias("y0"), (F.col("x0") + F.greatest(F.lit(0.0), F.col("x1") - F.col("x0"))).alias("x1"), F.col("y1"))
    return regions.rule_bands(regions.rule_lines(segments, F.lit(B.PAGE_WIDTH)), B.PAGE_WIDTH)


@query(
    "grobid_regions",
    """SELECT doc_id, (doc_id % 7 + 1)::INTEGER AS page_no, 10.0 * 20 / 9 AS x0, (20.0 + doc_id % 5) * 20 / 9 AS y0, 110.0 * 20 / 9 AS x1, (20.0 + doc_id % 5 + 30.0) * 20 / 9 AS y1 FROM documents""",
)
def _(spark, d):
    i = F.col("doc_id")
    part = F.concat((i % 7 + 1).cast("string"), F.lit(",10,"), (i % 5 + 20).cast("string"), F.lit(",100,30"))
    coords = docs(spark, d).select("doc_id", F.concat(part, F.lit(";"), part, F.lit(";0,1,1,1,1;x,1;2,5,5,0,9")).alias("coords"))
    return regions.grobid_regions(coords)


SQL["grobid_regions"] = """SELECT doc_id, (doc_id % 7 + 1)::INTEGER AS page_no, round(10 * 160::DOUBLE / 72, 6) AS x0, round((20 + doc_id % 5) * 160::DOUBLE / 72, 6) AS y0, round(110 * 160::DOUBLE / 72, 6) AS x1, round((50 + doc_id % 5) * 160::DOUBLE / 72, 6) AS y1 FROM documents"""
_grobid = QUERIES["grobid_regions"]
QUERIES["grobid_regions"] = lambda spark, d: _grobid(spark, d).withColumns({n: F.round(n, 6) for n in regions.RECT})


@query(
    "layout_rects",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'reference' ELSE 'table' END AS kind, x0, y0, x1, y1 FROM (
       SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 20.0 ELSE 5.0 END AS x0, CASE doc_id % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 30.0 ELSE 6.0 END AS y0,
       CASE doc_id % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 70.0 ELSE 900.0 END AS x1, CASE doc_id % 3 WHEN 0 THEN 90.0 WHEN 1 THEN 90.0 ELSE 800.0 END AS y1 FROM documents)""",
)
def _(spark, d):
    k = F.col("doc_id") % 3
    dbl = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    nodes = docs(spark, d).select(
        "doc_id", F.lit(1).alias("page_no"), F.when(k == 2, " Reference  List").otherwise("Table Region").alias("label"), F.when(k == 0, dbl(10, 10, 100, 90)).when(k == 2, dbl(1, 1, 3, 3)).alias("coordinate"),
        F.when(k == 1, dbl(20, 30, 50, 60)).alias("bbox"), F.when(k == 2, F.array(dbl(5, 800), dbl(2000, 6))).alias("polygon"),
    )
    found = X.layout_rects(nodes, 900.0, 1000.0).withColumn("bbox_", F.lit(0)).drop("bbox_")
    return regions.layout_hints(found).select("doc_id", "kind", *regions.RECT)


SQL["layout_rects"] = SQL["layout_rects"].replace("WHEN 1 THEN 70.0 ELSE 900.0", "WHEN 1 THEN 50.0 ELSE 900.0").replace("WHEN 1 THEN 90.0 ELSE 800.0", "WHEN 1 THEN 60.0 ELSE 800.0")


@query(
    "ocr_lines",
    "SELECT doc_id, text, (doc_id % 50)::INTEGER AS x0, 10 AS y0, (doc_id % 50 + 40)::INTEGER AS x1, 30 AS y1 FROM documents",
)
def _(spark, d):
    x = (F.col("doc_id") % 50).cast("double")
    point = lambda a, b: F.array(a, b)
    poly = F.array(point(x, F.lit(10.5)), point(x + 40.9, F.lit(12.0)), point(x + 40, F.lit(30.2)), point(x, F.lit(29.0)))
    return X.ocr_lines(docs(spark, d).select("doc_id", F.array(F.col("text"), F.lit("no polygon")).alias("rec_texts"), F.array(poly).alias("rec_polys")), ["doc_id"])


@query(
    "ocr_markdown",
    "SELECT doc_id, CASE WHEN trim(text) = '' THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) END || 'end' AS markdown FROM documents",
)
def _(spark, d):
    s = F.col("text")
    part = lambda t: F.struct(F.struct(t.alias("text")).alias("markdown"))
    reply = F.to_json(F.struct(F.struct(F.array(part(s), part(F.lit(" end "))).alias("layoutParsingResults")).alias("result")))
    jsonl = docs(spark, d).select("doc_id", F.concat(reply, F.lit("\n{broken\n\n")).alias("raw"))
    return jsonl.select("doc_id", X.markdown_from_jsonl(F.col("raw")).alias("markdown"))


@query(
    "block_style",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 11.0 ELSE 9.0 + doc_id % 7 END AS font_size, ((doc_id * 4099) // 65536 % 256)::INTEGER AS r, ((doc_id * 4099) // 256 % 256)::INTEGER AS g, ((doc_id * 4099) % 256)::INTEGER AS b FROM documents",
)
def _(spark, d):
    i = F.col("doc_id")
    span = lambda size: F.struct(F.col("text").alias("text"), size.cast("double").alias("size"), (i * 4099).alias("color"))
    lines = F.array(F.struct(F.array(span(F.when(i % 2 == 0, F.lit(None)).otherwise(9 + i % 7)), span(F.when(i % 2 == 0, F.lit(None)).otherwise(F.lit(2)))).alias("spans")))
    s = docs(spark, d).select("doc_id", B.block_style(lines).alias("s"))
    return s.select("doc_id", "s.font_size", "s.color.r", "s.color.g", "s.color.b")


@query(
    "references_suffix_window",
    """WITH t AS (SELECT conv_id, turn, role, count(*) OVER w AS n, sum((role = 'user')::INTEGER) OVER w AS entries, max(40.0 * turn + 30) OVER (PARTITION BY conv_id) AS bottom FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY 40.0 * turn, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT conv_id AS doc_id, 1 AS page_no, min(40.0 * turn) AS start_y FROM t WHERE role = 'user' AND (entries >= 6 OR (40.0 * turn >= bottom * 0.32 AND entries >= 3 AND entries / n >= 0.42) OR (entries >= 4 AND entries / n >= 0.6)) GROUP BY 1""",
)
def _(spark, d):
    t = B.table(spark, d, "conversations")
    y = F.col("turn") * 40.0
    return regions.references_start(t.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("turn").alias("block_index"), y.alias("y0"), (y + 30).alias("y1"), F.lit(False).alias("heading"), (F.col("role") == "user").alias("entry"), F.lit(False).alias("contributions")))


@query(
    "reference_anchor",
    f"WITH {S_BLOCKS}, h AS (SELECT *, text = arg_min(text, (page_no, block_index)) OVER (PARTITION BY doc_id) AS x FROM blocks), f AS (SELECT doc_id, page_no, block_index, y0 FROM blocks WHERE doc_id % 3 = 0 AND block_index % 7 = 5) SELECT doc_id, arg_min(page_no, (page_no, block_index)) AS anchor_page, arg_min(y0, (page_no, block_index)) AS anchor_y FROM f GROUP BY 1",
)
def _(spark, d):
    text = F.when((F.col("doc_id") % 3 == 0) & (F.col("block_index") % 7 == 5), F.lit("7. References:")).otherwise(F.col("text"))
    b = blocks(spark, d).withColumn("text", text)
    return regions.reference_anchor(b.withColumn("heading", is_.reference_heading(view(F.col("text")))))


# Merging and packing --------------------------------------------------------------------------------------------------


@query(
    "batch_pack",
    f"""WITH RECURSIVE {S_BLOCKS}, o AS (SELECT doc_id, list(length(text) ORDER BY page_no, block_index) AS c, list([page_no, block_index] ORDER BY page_no, block_index) AS ks FROM blocks GROUP BY 1),
    f(doc_id, c, ks, i, batch, n, size, out) AS (
      SELECT doc_id, c, ks, 0, 0, 0, 0::BIGINT, []::INTEGER[] FROM o UNION ALL
      SELECT doc_id, c, ks, i + 1, batch + (c[i+1] >= 980 OR n = 0 OR n >= 36 OR size + c[i+1] > 8000)::INTEGER,
        CASE WHEN c[i+1] >= 980 THEN 0 WHEN n = 0 OR n >= 36 OR size + c[i+1] > 8000 THEN 1 ELSE n + 1 END, CASE WHEN c[i+1] >= 980 THEN 0 WHEN n = 0 OR n >= 36 OR size + c[i+1] > 8000 THEN c[i+1] ELSE size + c[i+1] END,
        list_append(out, batch + (c[i+1] >= 980 OR n = 0 OR n >= 36 OR size + c[i+1] > 8000)::INTEGER) FROM f WHERE i < len(c))
    SELECT doc_id, ks[j][1] AS page_no, ks[j][2] AS block_index, c[j]::INTEGER AS chars, out[j] AS batch FROM (SELECT *, unnest(generate_series(1, len(c))) AS j FROM f WHERE i = len(c))""",
)
def _(spark, d):
    rows = blocks(spark, d).select("doc_id", "page_no", "block_index", F.length("text").cast("int").alias("chars"))
    return grouping.pack(rows, ["doc_id"], ["page_no", "block_index"], "chars")


S_NOTATION = f"""(regexp_matches(flat, '^(?:[''`‘’•·\\-*]\\s*)?(?:{S_BARE})') OR (length(flat) <= 140 AND (regexp_matches(lower(flat), '{S_LEFT}(count\\s*\\(|(state\\p{{Nd}}*|next|res|minpos){S_RIGHT})')
      OR regexp_matches(flat, '[A-Za-z]\\[[^\\]]+\\]|\\|\\||:=|⊕|←'))))"""
#: Blocks of equal widths, 22 pixels from line to line: one belongs to the one before where that is the line above it.
S_FOLLOWS = (
    S_BLOCKS
    + f""",
tight AS (SELECT doc_id, page_no, block_index, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, {s_flat('text')} AS flat, (block_index % 40) // 20 AS half FROM blocks),
told AS (SELECT *, {S_NOTATION} AS notation, length(flat) <= 96 AND regexp_matches(flat, '(?i)^(?:section\\s+)?[ivxlcdm0-9.\\-: ]+[A-Za-z][A-Za-z \\-'']+$') AS heading,
  regexp_matches(flat, '[-=+*/^_⊕←,;:.(\\[]$') OR regexp_matches(lower(flat), '{S_LEFT}(?:for|where|then|that|with|s\\.t)$') AS is_open, NOT regexp_matches(flat, '(?i)^(?:[a-z]|[ivxlcdm]+|\\p{{Nd}}{{1,3}})[).:]\\s+') AS plain, regexp_matches(flat, '^[\\p{{Ll}}\\p{{Nd}}=+\\-*/^_(\\[{{⊕←]') AS low FROM tight),
near AS (SELECT *, lag(half) OVER w = half AND lag(block_index) OVER w = block_index - 1 AND NOT heading AND NOT lag(heading) OVER w AND (NOT (notation OR lag(notation) OVER w) OR (plain AND (low OR lag(is_open) OVER w))) AS f
  FROM told WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY half, block_index)),
follows AS (SELECT *, coalesce(f, false) AS follows FROM near)"""
)
S_MERGED = f"""WITH {S_FOLLOWS}, runs AS (SELECT *, sum((NOT follows)::INTEGER) OVER (PARTITION BY doc_id, page_no ORDER BY half, block_index) AS run FROM follows),
    parts AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_no, run ORDER BY block_index) - 1) // 3 AS third FROM runs), m AS (
    SELECT doc_id, page_no, min(block_index) AS first, max(block_index) AS last, any_value(half) AS half, count(*) AS n_parts, list_reduce(list(text ORDER BY block_index), lambda x, y: CASE WHEN ends_with(x, '-') THEN rtrim(x[1 : length(x) - 1]) || ltrim(y) ELSE x || chr(10) || y END) AS text FROM parts GROUP BY doc_id, page_no, run, third)
    SELECT doc_id, page_no, first AS block_index, (80 + 640 * half)::DOUBLE AS x0, (60 + 22 * (first % 20))::DOUBLE AS y0, (640 + 640 * half)::DOUBLE AS x1, (76 + 22 * (last % 20))::DOUBLE AS y1, text, n_parts FROM m"""


@query("fragment_pairs", f"WITH {S_FOLLOWS} SELECT doc_id, page_no, count(*) AS n, count_if(follows)::BIGINT AS n_follow FROM follows GROUP BY ALL")
def _(spark, d):
    return grouping.pairs(_tight(spark, d), B.PAGE_WIDTH).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"), F.count_if("follows").alias("n_follow"))


def _tight(spark, d):
    """Blocks with small gaps and equal widths, so that neighbours can merge."""
    k = F.col("block_index") % 20
    y0 = 60.0 + k * 22.0
    return blocks(spark, d).withColumns({"x0": 80.0 + F.floor(F.col("block_index") % 40 / 20) * 640.0, "y0": y0, "y1": y0 + 16.0}).withColumn("x1", F.col("x0") + 560.0).withColumn("base_font_size", F.lit(12.0))


@query("merge_fragments", S_MERGED)
def _(spark, d):
    return grouping.merge_fragments(_tight(spark, d).drop("font_size"), B.PAGE_WIDTH).select(*D.BLOCK, *regions.RECT, "text", "n_parts")


@query(
    "render_order",
    f"WITH {S_BLOCKS} SELECT doc_id, page_no, block_index, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, greatest(1.0, greatest(1.0, x1 - x0) * greatest(1.0, y1 - y0)) DESC, block_index)::INTEGER AS draw FROM blocks",
)
def _(spark, d):
    one = F.lit(1.0)
    b = blocks(spark, d).withColumns({"width": F.greatest(one, F.col("x1") - F.col("x0")), "height": F.greatest(one, F.col("y1") - F.col("y0"))})
    return grouping.render_order(b).select(*D.BLOCK, "draw")


# Predicates -----------------------------------------------------------------------------------------------------------

S_FLAGS = f"""WITH {S_LABELLED}, f AS (SELECT doc_id, block_index, kind, text, {s_flat('text')} AS flat, lower({s_flat('text')}) AS low, {s_words('text')} AS w, {s_marks('text', '.?!;:')} AS p FROM labelled)"""


@query(
    "watermark_filter",
    f"""WITH {S_LABELLED}, t AS (SELECT doc_id, block_index, (doc_id + block_index) % 3 AS k, CASE (doc_id + block_index) % 3 WHEN 0 THEN text || ' Authorized Licensed use limited to: X' WHEN 1 THEN text || ' Downloaded on May 1 from IEEE Xplore. Restrictions apply.' ELSE text END AS text FROM labelled)
    SELECT doc_id, block_index FROM t WHERE lower(text) LIKE '%authorized licensed use limited to%' OR (k = 1 AND length({s_flat('text')}) <= 420)""",
)
def _(spark, d):
    k = (F.col("doc_id") + F.col("block_index")) % 3
    t = labelled(spark, d).withColumn("text", F.when(k == 0, F.concat("text", F.lit(" Authorized Licensed use limited to: X"))).when(k == 1, F.concat("text", F.lit(" Downloaded on May 1 from IEEE Xplore. Restrictions apply."))).otherwise(F.col("text")))
    return t.filter(is_.licence_watermark(view(F.col("text")))).select(*KEY)


@query(
    "caption_filter",
    S_FLAGS + " SELECT doc_id, block_index FROM f WHERE regexp_matches(flat, '(?i)^\\s*(fig(ure)?|table)\\s*[\\.\\-: ]*([ivxlcdm]+|\\d+)') AND kind IN (1, 2) AND NOT (w >= 6 AND low LIKE '% lists %') AND w < 36 AND NOT (p >= 2 AND w >= 14) AND NOT (w >= 12 AND p >= 1 AND contains(flat, ',')) AND NOT (w >= 8 AND contains(flat, ',')) AND w <= 12",
)
def _(spark, d):
    return labelled(spark, d).filter(is_.standalone_caption(view(F.col("text")))).select(*KEY)


@query("header_footer", f"WITH {S_BLOCKS}, t AS (SELECT doc_id, page_no, block_index, y0, y1, CASE block_index % 4 WHEN 0 THEN 'IEEE TRANSACTIONS' WHEN 1 THEN '17' WHEN 2 THEN 'all rights reserved' ELSE 'plain words here' END AS text FROM blocks) SELECT doc_id, page_no, block_index FROM t WHERE (y1 <= 167.2 AND block_index % 4 IN (0, 1)) OR (y0 >= 1584 AND block_index % 4 IN (1, 2))")
def _(spark, d):
    k = F.col("block_index") % 4
    t = blocks(spark, d).withColumn("text", F.when(k == 0, "IEEE TRANSACTIONS").when(k == 1, "17").when(k == 2, "all rights reserved").otherwise("plain words here"))
    return t.filter(is_.running_header_footer(view(F.col("text")), F.col("y0"), F.col("y1"), F.lit(B.PAGE_HEIGHT))).select(*D.BLOCK)


@query("reference_entries", S_FLAGS + " SELECT doc_id, block_index FROM f WHERE kind = 3")
def _(spark, d):
    return labelled(spark, d).filter(is_.reference_entry(view(F.col("text")))).select(*KEY)


@query("reference_headings", S_FLAGS + " SELECT doc_id, block_index FROM f WHERE kind = 7")
def _(spark, d):
    return labelled(spark, d).filter(is_.reference_heading(view(F.col("text")))).select(*KEY)


@query("algorithm_blocks", S_FLAGS + " SELECT doc_id, block_index FROM f WHERE kind = 4")
def _(spark, d):
    return labelled(spark, d).filter(is_.algorithm_block(view(F.col("text")))).select(*KEY)


@query(
    "title_blocks",
    f"WITH {S_BLOCKS}, f AS (SELECT doc_id, block_index, text, {s_flat('text')} AS flat, {s_words('text')} AS w, {s_marks('text', '.?!;:')} AS p FROM blocks) SELECT doc_id, block_index FROM f WHERE flat <> '' AND w BETWEEN 6 AND 36 AND p <= 2 AND {s_cjk('flat')} <= 2 AND NOT regexp_matches(flat, '[=<>/\\[\\]{{}}_^$]') AND NOT contains(flat, 'doi') AND NOT contains(flat, 'arxiv') AND NOT contains(flat, chr(92)) AND NOT contains(flat, 'http://') AND NOT contains(flat, 'https://') AND length(trim(text)) >= 18",
)
def _(spark, d):
    return pairs(spark, d).filter(is_.title_block(view(F.col("source")))).select(*KEY)


@query("predicate_flags")
def _(spark, d):
    df, v = with_view(labelled(spark, d), "text")
    df, v = with_known(df, v, is_.line_facts, is_.formula_narrative, is_.formula_block, is_.standalone_caption, is_.skipped, is_.numbered_narrative_list, is_.narrative_prose, is_._explains, is_.table_caption, is_.table_header, is_.table_body)
    tests = {
        "formula": is_.formula(v.text), "formula_line": is_.formula_line(v.text), "formula_block": is_.formula_block(v), "narrative": is_.formula_narrative(v), "fragment": is_.formula_narrative_fragment(v), "caption": is_.standalone_caption(v),
        "skipped": is_.skipped(v), "prose": is_.narrative_prose(v), "numbered": is_.numbered_narrative_list(v), "paragraph": is_.paragraph_block(v), "algorithm": is_.algorithm_block(v), "table_caption": is_.table_caption(v),
        "table_header": is_.table_header(v), "table_body": is_.table_body(v), "table_like": is_.table_like(v), "entry": is_.reference_entry(v), "title": is_.title_block(v), "notation": is_.notation_line(v.text), "retry": is_.force_retry(v),
        "translatable": is_.translatable(v), "target_heading": is_.target_heading(v.text), "logged": is_.worth_logging(v),
    }
    return df.select(*KEY, *(t.alias(n) for n, t in tests.items()))


@query("skip_reason_histogram")
def _(spark, d):
    b = blocks(spark, d)
    b = b.drop("text").join(labelled(spark, d), KEY)
    flags = D.flagged(b)
    return D.admission(flags, D.non_translatable(flags, B.regions_for(b))).groupBy(F.coalesce("skip_reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# Gates ----------------------------------------------------------------------------------------------------------------


@query("echo_gate", f"WITH {S_PAIRS}, {S_ECHO} SELECT doc_id, block_index, echo FROM e")
def _(spark, d):
    return pairs(spark, d).select(*KEY, Q.echo(F.col("source"), F.col("translated")).alias("echo"))


@query(
    "batch_echo",
    f"WITH {S_PAIRS}, {S_ECHO} SELECT doc_id, count(*) AS n, count_if(echo)::BIGINT AS bad, count_if(echo) > 0 AND (count(*) = 1 OR count_if(echo) >= greatest(2, count(*) // 2)) AS too_many FROM e GROUP BY 1",
)
def _(spark, d):
    e = pairs(spark, d).select("doc_id", Q.echo(F.col("source"), F.col("translated")).alias("e"))
    n = e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("e").alias("bad"))
    return n.withColumn("too_many", Q.batch_echo(F.col("bad"), F.col("n")))


@query(
    "length_gate",
    f"""WITH {S_PAIRS}, v AS (SELECT doc_id, block_index, {s_flat('source')} AS s, {s_flat('translated')} AS t FROM pairs), c AS (SELECT *, lower(s) AS sl, length(s) AS n, length(t) AS m, {s_words('s')} AS w, {s_cjk('s')} AS sz, {s_cjk('t')} AS z, {s_marks('t', '。！？.;')} AS p,
      len(regexp_extract_all(s, {S_ITEM})) AS si, len(regexp_extract_all(t, {S_ITEM})) AS ti FROM v)
    SELECT doc_id, block_index, s <> '' AND t <> '' AND ((sz <= 2 AND w BETWEEN 4 AND 28 AND n <= 200 AND z >= greatest(70, w * 5) AND m >= greatest(170, floor(n * 2.4))) OR (n <= 140 AND z >= 80 AND m >= 190 AND p >= 3)
      OR (si >= 1 AND ti > si AND n <= 240) OR (si = 0 AND ti >= 2 AND n <= 180 AND w >= 6) OR (si >= 1 AND ti = 0 AND n <= 260 AND w >= 6 AND z >= 6)
      OR (w >= 24 AND n >= 240 AND m <= greatest(30, floor(n * 0.2)) AND z <= greatest(20, floor(w * 0.55))) OR (w >= 55 AND n >= 520 AND m <= greatest(42, floor(n * 0.14)))
      OR (n <= 180 AND w >= 5 AND p >= 3 AND m >= floor(n * 1.65) AND z >= 72)
      OR (n <= 130 AND w >= 5 AND regexp_matches(sl, '( for both the| for the| of the| and the| to the| in the|,)$') AND z >= 70 AND m >= 150)
      OR (n <= 200 AND regexp_matches(sl, '(-| and| of)$') AND p >= 2 AND z >= 55 AND m >= floor(n * 1.45)) OR (n <= 170 AND w >= 8 AND regexp_matches(s, '^\\p{{Ll}}') AND p >= 2 AND z >= 42 AND m >= floor(n * 1.18))) AS extreme FROM c""",
)
def _(spark, d):
    return pairs(spark, d).select(*KEY, Q.extreme_length(view(collapse(F.col("source"))), view(collapse(F.col("translated")))).alias("extreme"))


@query("quality_gate")
def _(spark, d):
    df, s = with_view(pairs(spark, d), "source", "_s_")
    df = Q.judge(Q.judge(df, "source", "translated", "low_quality"), "source", "translated", "low_quality_lines", strict_lines=True)
    return df.select(*KEY, "low_quality", "low_quality_lines", Q.residue(s.flat, F.col("translated")).alias("residue"))


@query("normalise_translation")
def _(spark, d):
    return Q.normalise(pairs(spark, d), "source", "translated").select(*KEY, "normalised")


@query("meta_lines", f"WITH {S_PAIRS} SELECT doc_id, block_index, (doc_id + block_index) % 6 = 4 AND length({s_flat('translated')}) >= 8 AND {s_words('translated')} >= 3 AS meta FROM pairs")
def _(spark, d):
    return pairs(spark, d).select(*KEY, Q.has_meta(F.col("translated")).alias("meta"))


@query(
    "section_headings",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'IV. 相关工作' WHEN doc_id % 3 = 1 THEN (doc_id % 9) || '.1 结论' END AS heading, CASE WHEN doc_id % 3 = 2 THEN '例如' || CASE WHEN doc_id % 2 = 0 THEN '：' ELSE '' END END AS phrase FROM documents",
)
def _(spark, d):
    i, k = F.col("doc_id"), F.col("doc_id") % 3
    text = F.when(k == 0, "Section IV. Related  Work").when(k == 1, F.concat((i % 9).cast("string"), F.lit(".1 Conclusions"))).otherwise(F.concat(F.lit("For example"), F.when(i % 2 == 0, ":").otherwise(",")))
    t = docs(spark, d).select("doc_id", text.alias("t"))
    return t.select("doc_id", Q.section_heading(F.col("t")).alias("heading"), Q.short_phrase(F.col("t")).alias("phrase"))


# Sessions -------------------------------------------------------------------------------------------------------------


@query("page_states", f"WITH {S_PAGES} SELECT session_id, page_no, status, warnings FROM states")
def _(spark, d):
    return states(spark, d).select("session_id", "page_no", "status", "warnings")


@query("session_status", f"WITH {S_PAGES} SELECT session_id, CASE WHEN bool_and(status = 'ready') THEN 'ready' WHEN bool_and(status IN ('ready', 'failed')) THEN 'failed' END AS final FROM states GROUP BY 1")
def _(spark, d):
    return S.final_status(states(spark, d))


@query(
    "first_readable",
    f"WITH {S_PAGES}, s AS (SELECT session_id, session_id::INTEGER % 12 AS n FROM states GROUP BY 1) SELECT s.session_id, count(DISTINCT p.page_no) = least(3, any_value(s.n)) AS first_readable_ready FROM s LEFT JOIN states p ON p.session_id = s.session_id AND p.page_no <= least(3, s.n) AND p.status IN ('ready', 'failed') GROUP BY 1",
)
def _(spark, d):
    return S.first_readable(states(spark, d), sessions(spark, d))


@query(
    "status_progress",
    f"WITH {S_PAGES} SELECT session_id, count(*) AS n_pages, count_if(status = 'pending')::BIGINT AS n_pending, count_if(status = 'processing')::BIGINT AS n_processing, count_if(status = 'ready')::BIGINT AS n_ready, count_if(status = 'failed')::BIGINT AS n_failed, sum(len(warnings))::BIGINT AS warnings_count FROM states GROUP BY 1",
)
def _(spark, d):
    return S.progress(states(spark, d))


@query("warnings_count", f"WITH {S_PAGES} SELECT session_id, sum(len(warnings))::BIGINT AS warnings_count FROM states GROUP BY 1")
def _(spark, d):
    return S.progress(states(spark, d)).select("session_id", "warnings_count")


@query(
    "page_ensure_window",
    f"WITH {S_PAGES}, v AS (SELECT DISTINCT session_id, page_no AS c, session_id::INTEGER % 12 AS n FROM changes) SELECT DISTINCT session_id, unnest(generate_series(greatest(1, c - 1), least(n, c + 1)))::INTEGER AS page_no FROM v",
)
def _(spark, d):
    views = changes(spark, d).select("session_id", F.col("page_no").alias("center"), (F.col("session_id").cast("int") % 12).alias("page_count")).distinct()
    return S.around(views)


@query(
    "priority_queue",
    f"WITH {S_PAGES}, q AS (SELECT DISTINCT session_id, page_no FROM changes WHERE event_id % 11 = 0) SELECT session_id, page_no, CASE WHEN page_no <= 3 THEN 'page_high' ELSE 'page_normal' END AS queue, status = 'failed' AS reset FROM states WHERE status IN ('pending', 'failed') AND NOT EXISTS (SELECT 1 FROM q WHERE q.session_id = states.session_id AND q.page_no = states.page_no)",
)
def _(spark, d):
    p = states(spark, d)
    return S.to_enqueue(p, p, changes(spark, d).filter("change_id % 11 = 0"))


@query(
    "export_coalesce",
    f"WITH {S_PAGES} SELECT session_id, page_no, CASE WHEN status = 'ready' THEN 't/' || page_no ELSE 'o/' || page_no END AS image, status = 'ready' AS translated FROM states WHERE status = 'ready' OR page_no % 4 <> 0",
)
def _(spark, d):
    p = states(spark, d)
    path = lambda t: F.concat(F.lit(t), F.col("page_no").cast("string")).alias("path")
    return X.export_manifest(p, p.filter("page_no % 4 <> 0").select("session_id", "page_no", path("o/")), p.filter("status = 'ready'").select("session_id", "page_no", path("t/")))


def _diagnostics(spark, d):
    k = F.col("change_id") % 4
    kind = F.element_at(F.array(*map(F.lit, S.KINDS)), (k + 1).cast("int"))
    return changes(spark, d).filter("status = 'failed'").select("session_id", "page_no", kind.alias("kind"), F.concat(F.lit("r"), F.col("change_id").cast("string")).alias("reason"))


@query(
    "report_by_kind",
    f"WITH {S_PAGES}, g AS (SELECT session_id, page_no, ['layout_overflow', 'image_ocr_failures', 'fallback_events', 'untranslated_blocks'][event_id % 4 + 1] AS kind, 'r' || event_id AS reason FROM changes WHERE status = 'failed') SELECT session_id, kind, count(*) AS n, string_agg(page_no || reason, ',' ORDER BY page_no, reason) AS items FROM g WHERE NOT (page_no = 3) GROUP BY ALL",
)
def _(spark, d):
    g = _diagnostics(spark, d)
    wide = S.report(S.without_page(g, g.filter("page_no = 3")))
    long_ = wide.select("session_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("items")) for k in S.KINDS))).alias("x")).filter(F.size("x.items") > 0)
    listed = F.array_join(F.transform("x.items", lambda i: F.concat(i["page_no"].cast("string"), i["reason"])), ",")
    return long_.select("session_id", "x.kind", F.size("x.items").cast("long").alias("n"), listed.alias("items"))


@query(
    "expiring_sessions",
    f"WITH {S_PAGES}, s AS (SELECT session_id, min(ts) + INTERVAL 120 MINUTE AS e FROM changes GROUP BY 1) SELECT session_id, CASE WHEN e <= TIMESTAMP '2024-01-01 04:00:00' THEN 'expired' WHEN e <= TIMESTAMP '2024-01-01 04:05:00' THEN 'expiring' ELSE 'live' END AS state FROM s",
)
def _(spark, d):
    return S.expiry(sessions(spark, d), F.lit("2024-01-01 04:00:00").cast("timestamp"))


@query(
    "page_events",
    f"WITH {S_PAGES} SELECT session_id, CASE status WHEN 'ready' THEN 'page_ready' WHEN 'failed' THEN 'page_failed' ELSE 'progress' END AS event, count(*) AS n FROM changes GROUP BY ALL",
)
def _(spark, d):
    return S.page_events(changes(spark, d)).groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("n"))


@query(
    "session_state",
    f"""WITH {S_PAGES}, s AS (SELECT session_id, session_id::INTEGER % 12 AS n, count(*)::INTEGER AS n_pages, sum(len(warnings))::BIGINT AS w, count(DISTINCT page_no) FILTER (page_no <= least(3, session_id::INTEGER % 12) AND status IN ('ready', 'failed')) AS done FROM states GROUP BY 1)
    SELECT session_id, 'created' AS overall_status, n AS page_count, n_pages, w AS warnings_count, done = least(3, n) AS first_readable_ready FROM s""",
)
def _(spark, d):
    return S.session_state(sessions(spark, d), states(spark, d)).select("session_id", "overall_status", "page_count", F.size("pages").alias("n_pages"), "warnings_count", "first_readable_ready")


# Translation ----------------------------------------------------------------------------------------------------------


def _store(spark: SparkSession):
    """Writes tables to the folder that the cluster shares, so that provider calls are made once."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="leafwork-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/leafwork-document-{uuid.uuid4().hex}"

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    return store


def document_flow(spark: SparkSession, d: str, flow: Callable[..., dict[str, DataFrame]] = D.run) -> dict[str, DataFrame]:
    b = blocks(spark, d)
    memory = _memory(spark, d).select("doc_id", "fp", "translation")
    return flow(b, B.regions_for(b), memory, [translate.Stub()], translate.Options(), _store(spark))


@query("translate_documents")
def _(spark, d):
    return document_flow(spark, d, D.translated)["translations"]


@query("fit_documents")
def _(spark, d):
    return document_flow(spark, d)["fitted"].drop("lines")


# Rules over every block as it is, with texts on both sides of the thresholds --------------------------------------------

#: One line each; they are judged beside the blocks of the documents, as blocks of document -1.
PROBES = [
    "x = y + 1", "where x = y", "a - b / c * d", "and/or", "f(x, y)", "\\alpha + \\beta", "r next", "state12 is set", "restate 1", "count (x) := 2", "a[1] and b[2]", "TABLE II: accuracy of all", "Table 3 lists what each of these many methods needs here",
    "Table 4 gives. Many words. Follow here and there and in every other place of the whole long caption, really", "Tables 3", "table x", "Theorem 1. Every value stays inside the group that was chosen", "the proof is short", "Proofs are long, and none of them fits the page at all, says the author",
    "1) we compute the sum of all values, send it to the next server, and then wait until all of them have replied to us", "- one two", "Values stay private. Servers learn sums only. Nobody else learns anything.", "One sentence alone, with some more words but only one stop here and now.",
    "5. 结论", "相关工作", "Section II 引言", "结论部分很长", "short", "twenty-four characters !", "一二三四五六七八一二三四五六七八一二三四五六七八", "for the", "minpos || 3", "s ← r ⊕ t", "=-=", "-", "3-4", "x -", "- x", "privacy-preserving", "≤≥", "I am a be to do", "é a ü b2 c_d e-f",
]


def _probed(spark: SparkSession, d: str) -> DataFrame:
    more = spark.createDataFrame([(-1, k, t) for k, t in enumerate(PROBES)], "doc_id long, block_index int, text string")
    return blocks(spark, d).select("doc_id", "block_index", "text").unionByName(more)


S_PROBED = (
    S_BLOCKS
    + """,
probed AS (SELECT doc_id, block_index, text FROM blocks UNION ALL SELECT -1, k, t FROM (VALUES """
    + ", ".join(f"({k}, '{t}')" for k, t in enumerate(PROBES))
    + f""") AS p(k, t)),
seen AS (SELECT doc_id, block_index, text, {s_flat('text')} AS flat, lower({s_flat('text')}) AS low, {s_words(s_flat('text'))} AS w, {s_marks(s_flat('text'), '.?!;:')} AS p, {s_cjk('text')} AS zh, len(regexp_extract_all(text, '\\p{{L}}')) / greatest(length({s_flat('text')}), 1) AS alpha FROM probed)"""
)
def s_word(pattern: str) -> str:
    """RE2 for a pattern of whole words, ``(?iU)\\b(...)\\b``, over texts in lower case."""
    return S_LEFT + pattern.removeprefix(r"(?iU)\b").removesuffix(r"\b") + S_RIGHT


S_MATH = """(len(regexp_extract_all(text, '[≤≥≈≠∑∫√±×÷∗−′″=+*^_<>]')) + len(list_filter(cs, lambda x, i: (x = '-' OR x = '/') AND (i = 1 OR i = length(text)
      OR regexp_matches(cs[i - 1], '[0-9)\\]} _=+*/^<>-]') OR regexp_matches(cs[i + 1], '[0-9(\\[{ _=+*/^<>-]')))))"""


@query(
    "symbol_counts",
    f"WITH {S_PROBED}, c AS (SELECT *, string_split(text, '') AS cs FROM probed) SELECT doc_id, block_index, {S_MATH}::INTEGER AS n_symbols, len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[A-Za-z]{{1,2}}')))::INTEGER AS n_short FROM c",
)
def _(spark, d):
    return _probed(spark, d).select(*KEY, is_.math_symbols(F.col("text")).cast("int").alias("n_symbols"), is_.short_tokens(F.col("text")).cast("int").alias("n_short"))


@query("paragraph_rule", f"WITH {S_PROBED} SELECT doc_id, block_index, {s_marks('text', '.?!;')} >= 1 AND w >= 8 AS paragraph, length(flat) >= 24 AND (w >= 4 OR zh >= 8) AS logged FROM seen")
def _(spark, d):
    df, v = with_view(_probed(spark, d), "text")
    return df.select(*KEY, is_.paragraph_block(v).alias("paragraph"), is_.worth_logging(v).alias("logged"))


@query(
    "prose_rule",
    f"""WITH {S_PROBED} SELECT doc_id, block_index, false AS numbered, flat <> '' AND ((w >= 5 AND regexp_matches(low, '^(?:the\\s+)?(definition|theorem|lemma|corollary|proposition|proof|remark|example){S_RIGHT}'))
      OR (w >= 16 AND regexp_matches(low, '^(?:[-*•]|(?:\\p{{Nd}}{{1,3}}|[ivxlcdm]{{1,6}})[).])\\s+[a-z]')) OR (w >= 10 AND p >= 2 AND alpha >= 0.35) OR (w >= 26 AND p >= 2 AND alpha >= 0.45)
      OR (w >= 14 AND p >= 1 AND length(flat) >= 42 AND alpha >= 0.36)) AS prose FROM seen""",
)
def _(spark, d):
    df, v = with_view(_probed(spark, d), "text")
    return df.select(*KEY, is_.numbered_narrative_list(v).alias("numbered"), is_.narrative_prose(v).alias("prose"))


@query(
    "notation_rule",
    f"""WITH {S_PROBED} SELECT doc_id, block_index, flat <> '' AND (regexp_matches(flat, '^(?:[''`‘’•·\\-*]\\s*)?(?:{S_BARE})') OR (length(flat) <= 140 AND (regexp_matches(low, '{S_LEFT}(count\\s*\\(|(state\\p{{Nd}}*|next|res|minpos){S_RIGHT})')
      OR regexp_matches(flat, '[A-Za-z]\\[[^\\]]+\\]|\\|\\||:=|⊕|←')))) AS notation FROM seen""",
)
def _(spark, d):
    return _probed(spark, d).select(*KEY, is_.notation_line(F.col("text")).alias("notation"))


@query(
    "table_caption_rule",
    f"""WITH {S_PROBED} SELECT doc_id, block_index, regexp_matches(low, '^table\\s+([ivxlcm]+|\\p{{Nd}}+)') AND NOT (w >= 6 AND regexp_matches(low, '{s_word(P.TABLE_VERB)}')) AND w < 36 AND NOT (p >= 2 AND w >= 14)
      AND NOT (w >= 12 AND p >= 1 AND (contains(flat, ',') OR regexp_matches(low, '{s_word(P.TABLE_CONTINUATION)}'))) AND NOT (w >= 10 AND (contains(low, ' that ') OR contains(low, ' since '))) AS caption FROM seen""",
)
def _(spark, d):
    df, v = with_view(_probed(spark, d), "text")
    return df.select(*KEY, is_.table_caption(v).alias("caption"))


@query(
    "target_heading_rule",
    f"""WITH {S_PROBED} SELECT doc_id, block_index, flat <> '' AND ((length(flat) <= 28 AND regexp_full_match(low, '(?:section\\s+)?(?:\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*|[ivxlcdm]+)\\s*[).:：\\-]?\\s*(?:相关工作|参考文献|引言|摘要|结论|实验(?:评估|结果)?|方法|预备知识|问题定义|系统模型)\\s*'))
      OR replace(flat, ' ', '') IN ({', '.join(f"'{h}'" for h in P.TARGET_HEADINGS)})) AS heading FROM seen""",
)
def _(spark, d):
    return _probed(spark, d).select(*KEY, is_.target_heading(F.col("text")).alias("heading"))


@query(
    "text_forms",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS s FROM documents), f AS (SELECT doc_id, s, CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || s || chr(10) || '```' WHEN 1 THEN '  ```' || s || '```  ' WHEN 2 THEN ' ' || s || ' ' ELSE s || '```' END AS fenced,
      CASE doc_id % 5 WHEN 0 THEN ' Academic-Conservative ' WHEN 1 THEN 'DEFAULT' WHEN 2 THEN 'academic' WHEN 3 THEN '' ELSE ' plain ' || doc_id || ' ' END AS profile, 'a; 1) b' || repeat('c', doc_id % 7) || '：2、d' AS items FROM l)
    SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN trim(s) WHEN doc_id % 4 = 2 THEN trim(s) ELSE trim(s || '```') END AS inner_text, CASE WHEN doc_id % 5 = 4 THEN 'plain ' || doc_id ELSE '' END AS style, [3, 8 + doc_id % 7] AS places FROM f""",
)
def _(spark, d):
    i, s = F.col("doc_id"), F.get(F.split("text", "\n"), F.lit(0))
    fenced = F.when(i % 4 == 0, F.concat(F.lit("```json\n"), s, F.lit("\n```"))).when(i % 4 == 1, F.concat(F.lit("  ```"), s, F.lit("```  "))).when(i % 4 == 2, F.concat(F.lit(" "), s, F.lit(" "))).otherwise(F.concat(s, F.lit("```")))
    profile = F.when(i % 5 == 0, " Academic-Conservative ").when(i % 5 == 1, "DEFAULT").when(i % 5 == 2, "academic").when(i % 5 == 3, "").otherwise(F.concat(F.lit(" plain "), i.cast("string"), F.lit(" ")))
    items = F.concat(F.lit("a; 1) b"), F.repeat(F.lit("c"), (i % 7).cast("int")), F.lit("：2、d"))
    return docs(spark, d).select("doc_id", strip_fence(fenced).alias("inner_text"), style(profile).alias("style"), item_positions(items).alias("places"))


@query(
    "rect_relations",
    f"""WITH {S_BLOCKS.replace('blocks AS (', 'blocks AS MATERIALIZED (')}, {S_REGIONS.replace('regions AS (', 'regions AS MATERIALIZED (')}
    SELECT b.doc_id, b.page_no, b.block_index, count_if(b.x1 >= r.x0 AND r.x1 >= b.x0 AND b.y1 >= r.y0 AND r.y1 >= b.y0)::BIGINT AS n_touching,
      round(max(greatest(0.0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) / greatest(1.0, least(b.x1 - b.x0, r.x1 - r.x0))), 6) AS most FROM blocks b JOIN regions r ON b.doc_id = r.doc_id AND b.page_no = r.page_no GROUP BY ALL""",
)
def _(spark, d):
    b = blocks(spark, d)
    other = B.regions_for(b).select(*D.PAGE, *(F.col(n).alias(f"r_{n}") for n in regions.RECT))
    both = b.join(other, D.PAGE)
    return both.groupBy(*D.BLOCK).agg(F.count_if(G.touches(Rect.of(), Rect.of("r_"))).alias("n_touching"), F.round(F.max(G.horizontal_overlap(Rect.of(), Rect.of("r_"))), 6).alias("most"))


@query(
    "glossary_first_pages",
    f"WITH {S_BLOCKS}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM blocks WHERE page_no <= 5), n AS (SELECT doc_id, term, count(*) AS n FROM t WHERE regexp_full_match(term, '[A-Z]{{2,8}}s?') GROUP BY ALL) SELECT doc_id, term, n FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= 12",
)
def _(spark, d):
    return glossary.top_terms(glossary.first_pages(blocks(spark, d)), by=["doc_id"])


@query(
    "image_versions",
    f"WITH {S_PAGES} SELECT session_id, page_no, greatest(event_id * 1000, epoch_us(ts) // 1000) AS version FROM changes QUALIFY row_number() OVER (PARTITION BY session_id, page_no ORDER BY ts DESC, event_id DESC) = 1",
)
def _(spark, d):
    c = changes(spark, d).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    last = c.groupBy("session_id", "page_no").agg(F.max(F.struct("updated_at", "change_id")).alias("m"))
    return last.select("session_id", "page_no", S.polled_version(F.col("m.change_id").cast("long") * 1000, F.col("m.updated_at")).alias("version"))


@query(
    "swept_sessions",
    f"WITH {S_PAGES}, s AS (SELECT session_id, min(ts) + INTERVAL 120 MINUTE AS e FROM changes GROUP BY 1) SELECT session_id, CASE WHEN e <= TIMESTAMP '2024-01-01 04:00:00' THEN 'expired' ELSE 'created' END AS overall_status FROM s WHERE e + INTERVAL 120 SECOND > TIMESTAMP '2024-01-01 04:00:00'",
)
def _(spark, d):
    return S.swept(sessions(spark, d), F.lit("2024-01-01 04:00:00").cast("timestamp")).select("session_id", "overall_status")


@query(
    "session_events",
    f"""WITH {S_PAGES}, s AS (SELECT session_id, min(ts) + INTERVAL 120 MINUTE AS e FROM changes GROUP BY 1), f AS (SELECT session_id, CASE WHEN bool_and(status = 'ready') THEN 'session_ready' WHEN bool_and(status IN ('ready', 'failed')) THEN 'session_failed' END AS event FROM states GROUP BY 1),
    x AS (SELECT session_id, CASE status WHEN 'ready' THEN 'page_ready' WHEN 'failed' THEN 'page_failed' ELSE 'progress' END AS event FROM changes UNION ALL SELECT session_id, event FROM f WHERE event IS NOT NULL
      UNION ALL SELECT session_id, 'session_expiring' FROM s WHERE e > TIMESTAMP '2024-01-01 04:00:00' AND e <= TIMESTAMP '2024-01-01 04:05:00' UNION ALL SELECT session_id, 'provider_switched' FROM changes WHERE status = 'failed' AND event_id % 2 = 0)
    SELECT session_id, event, count(*) AS n FROM x GROUP BY ALL""",
)
def _(spark, d):
    c = changes(spark, d)
    moved = c.filter("status = 'failed' and change_id % 2 = 0").select("session_id", "page_no", F.lit("a").alias("from_provider"), F.lit("b").alias("to_provider"), F.col("error").alias("reason"))
    events = S.session_events(c, states(spark, d), sessions(spark, d), moved, F.lit("2024-01-01 04:00:00").cast("timestamp"))
    return events.groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["QUERIES", "SQL", "document_flow", "layout", "P"]
