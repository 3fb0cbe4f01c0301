"""URL filters: a sort-merge range join of urls with host and path rules.

The labels of a host, reversed (``blog.example.net`` is ``net.example.blog.``), turn "this host and all its
subdomains" into a prefix, and so into an interval of the sorted keys. Intervals of prefixes nest, so a sweep over sorted
urls and rules needs only a stack of the rules that are open now.

* Up to ``MAX_RULE_BYTES`` of rules, each task sorts its own urls (Spark's sort, which spills) and sweeps them against the
  rules, which are shipped once: no shuffle at all, however many urls one host has.
* Beyond that, urls and rules are dealt to ranges of keys; a rule goes to each range its interval meets, and urls of a key
  with more than a range's share are spread over all ranges that this key spans.

Null or malformed urls have an empty host and path, fit no rule, and get the default verdict. Repeated rows each get a row.
Of rules that fit, the longest (host and path together) wins; on a tie the longer host, then ``block`` before ``allow``. Rules
that are repeated count once, rules with nulls are void. Empty tables on either side are no error: without rules every url gets
the default. Columns that the caller keeps, whatever their names, are returned as they are; a kept column named like a result
(host, path, rule, verdict) is an error, as there would be two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rules of more bytes are not shipped to every task but dealt out by range.
MAX_RULE_BYTES = 32 << 20
DEFAULT = "allow"
#: The rules of the query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    u = F.col(url).cast("string")
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    df = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    authority = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    tail = F.expr("substring(_rest, length(regexp_extract(_rest, '^([^/?#]*)', 1)) + 1)")
    return df.withColumn("host", F.translate(authority, _UPPER, _UPPER.lower())).withColumn("path", F.regexp_extract(tail, r"^([^?#]*)", 1)).drop("_rest")


def reversed_host(column: str) -> F.Column:
    """``a.example.net`` as ``net\x01example\x01a\x01``: the separator sorts before every character of a host."""
    return F.concat(F.array_join(F.reverse(F.split(F.col(column), r"\.")), "\x01"), F.lit("\x01"))


def rule_key(host: str) -> str:
    return "\x01".join(reversed(host.split("."))) + "\x01"


class Sweep:
    """Feeds on rules and urls in the order of their keys; holds the open host intervals on a stack."""

    def __init__(self):
        self.stack: list[tuple[str, list]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, verdict: str, host: str, path: str) -> None:
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, []))
        self.stack[-1][1].append((path, verdict, host))

    def url(self, key: str, path: str) -> tuple[str | None, str]:
        self._close(key)
        best = None
        for _, rules in self.stack:
            for p, verdict, host in rules:
                if path.startswith(p):
                    rank = (len(host) + len(p), len(host), verdict == "block")
                    if best is None or rank > best[0]:
                        best = rank, host + p, verdict
        return (best[1], best[2]) if best else (None, DEFAULT)


def _sweep_sorted(rules: list[tuple[str, str, str, str]]):
    """For mapInArrow over urls sorted by key: merges them with the sorted rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sweep, at = Sweep(), 0
        for b in batches:
            found = []
            keys, paths = b.column("_key").to_pylist(), b.column("path").to_pylist()
            for key, path in zip(keys, paths):
                while at < len(rules) and rules[at][0] <= key:
                    sweep.rule(*rules[at])
                    at += 1
                found.append(sweep.url(key, path))
            kept = [i for i, n in enumerate(b.schema.names) if n != "_key"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in kept), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())],
                names=[*(b.schema.names[i] for i in kept), "rule", "verdict"],
            )

    return run


def _sweep_ranges(names: list[str]):
    """For mapInArrow over rows of urls and rules, sorted by range, key, and rules first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sweep, now = Sweep(), None
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("_range", "_key", "_kind", "path", "_verdict", "_host")}
            rows, found = [], []
            for i, (part, key, kind, path, verdict, host) in enumerate(zip(*cols.values())):
                if part != now:
                    sweep, now = Sweep(), part
                if kind == 0:
                    sweep.rule(key, verdict, host, path)
                else:
                    rows.append(i)
                    found.append(sweep.url(key, path))
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in names), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=[*names, "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, keep: list[str], max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """One row for each row of ``pages`` (column url): the columns ``keep``, host, path, rule, verdict.

    ``rules`` has verdict, host, path; rules with nulls are void.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    if twice := {"host", "path", "rule", "verdict"} & set(keep):
        raise ValueError(f"kept columns {sorted(twice)} are results too")
    rules = rules.select("verdict", F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path").dropna().distinct()
    urls = split_url(pages.select(*keep, *(["url"] if "url" not in keep else []))).withColumn("_key", reversed_host("host"))
    urls = urls.select(*keep, "host", "path", "_key")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in urls.drop("_key").schema] + [T.StructField(n, T.StringType()) for n in ("rule", "verdict")])
    size = rules.agg(F.sum(F.length("host") + F.length("path") + 40).alias("n")).first()["n"] or 0
    if size <= max_rule_bytes:
        ordered = sorted((rule_key(h), v, h, p) for v, h, p in map(tuple, rules.collect()))
        return urls.sortWithinPartitions("_key").mapInArrow(_sweep_sorted(ordered), schema)

    n = spark.sparkContext.defaultParallelism * 4
    cuts = _cuts(urls, n)
    bound = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")
    low = lambda k: F.size(F.filter(bound, lambda c: c < k))
    high = lambda k: F.size(F.filter(bound, lambda c: c <= k))
    # A key that is a cut itself may lie in any of the ranges low..high; its urls are spread over them.
    spread = F.pmod(F.xxhash64(*keep, "path"), high(F.col("_key")) - low(F.col("_key")) + 1).cast("int")
    left = urls.withColumn("_range", low(F.col("_key")) + spread).withColumn("_kind", F.lit(1)).withColumn("_verdict", F.lit(None).cast("string")).withColumn("_host", F.lit(None).cast("string"))
    key = reversed_host("host")
    right = rules.select("verdict", "host", "path", key.alias("_key")).withColumn("_range", F.explode(F.sequence(low(F.col("_key")), high(F.concat("_key", F.lit("\U0010ffff"))))))
    right = right.select("_range", "_key", "path", F.lit(0).alias("_kind"), F.col("verdict").alias("_verdict"), F.col("host").alias("_host"))
    both = left.unionByName(right, allowMissingColumns=True).repartition(n, "_range").sortWithinPartitions("_range", "_key", "_kind")
    return both.mapInArrow(_sweep_ranges([*keep, "host", "path"]), schema)


def _cuts(urls: DataFrame, n: int) -> list[str]:
    """n - 1 keys at about equal shares of the sorted urls; a hot key can come several times. A bounded sample places the cuts; every row is judged."""
    some = [r[0] for r in urls.select("_key").orderBy(F.xxhash64("_key", "path")).limit(20 * n).collect()]
    some.sort()
    return [some[i * len(some) // n] for i in range(1, n)] if some else []


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(common.table(spark, sf_dir, "pages"), rules, ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM a
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fit AS (
  SELECT b.page_id, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY b.page_id ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS k
  FROM b JOIN r ON (b.host = r.rhost OR ends_with(b.host, '.' || r.rhost)) AND starts_with(b.path, r.rpath)
)
SELECT b.page_id, b.host, b.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM b LEFT JOIN fit ON fit.page_id = b.page_id AND fit.k = 1
"""
