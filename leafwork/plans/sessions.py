"""Sessions, pages, reports and queues as tables: state is the latest row of a key, reports are rows that are only appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
TTL_MINUTES, NOTICE_MINUTES, TOMBSTONE_SECONDS = 120, 5, 120
FIRST_PAGES = 3
STATUSES = ["pending", "processing", "ready", "failed"]
KINDS = ["layout_overflow", "image_ocr_failures", "fallback_events", "untranslated_blocks"]

PAGE_STATE = T.StructType(
    [
        T.StructField("session_id", T.StringType()), T.StructField("page_no", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()), T.StructField("updated_at", T.TimestampType()),
    ]
)


def create(requests: DataFrame, ttl_minutes: int = TTL_MINUTES) -> tuple[DataFrame, DataFrame]:
    """(sessions, pages) for requests (session_id, page_count, created_at): every page is pending."""
    sessions = requests.select("session_id", F.lit("created").alias("overall_status"), "page_count", "created_at", (F.col("created_at") + F.make_interval(mins=F.lit(ttl_minutes))).alias("expires_at"))
    pages = requests.filter("page_count > 0").select(
        "session_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page_no"), F.lit("pending").alias("status"), F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("error"), F.col("created_at").alias("updated_at")
    )
    return sessions, pages


def latest_pages(changes: DataFrame, order: list[str]) -> DataFrame:
    """The state of each page after its changes: the last status and error, the last warnings that aren't null."""
    last = F.struct(*order)
    kept = F.max_by("warnings", F.when(F.col("warnings").isNotNull(), last))
    return changes.groupBy("session_id", "page_no").agg(F.max_by("status", last).alias("status"), kept.alias("warnings"), F.max_by("error", last).alias("error"), F.max(order[0]).alias("updated_at"))


def progress(pages: DataFrame) -> DataFrame:
    """Pages of each session by status, and its warnings."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    return pages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_pages"), *counts, F.coalesce(F.sum(F.size("warnings").cast("long")), F.lit(0)).cast("long").alias("warnings_count"))


def first_readable(pages: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, first_readable_ready: the first three pages are all there and done, well or badly."""
    n = F.least(F.lit(FIRST_PAGES), F.col("page_count"))
    done = pages.filter(F.col("page_no").between(1, FIRST_PAGES) & F.col("status").isin("ready", "failed")).groupBy("session_id").agg(F.collect_set("page_no").alias("done"))
    both = sessions.select("session_id", "page_count").join(done, "session_id", "left")
    have = F.size(F.filter(F.coalesce("done", F.array().cast("array<int>")), lambda p: p <= n))
    return both.select("session_id", (have == n).alias("first_readable_ready"))


def final_status(pages: DataFrame) -> DataFrame:
    """session_id, final: ready if all pages are, failed if all are done and some failed, null while some aren't done."""
    ready, done = F.bool_and(F.col("status") == "ready"), F.bool_and(F.col("status").isin("ready", "failed"))
    return pages.groupBy("session_id").agg(F.when(ready, "ready").when(done, "failed").alias("final"))


def session_state(sessions: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each session with its pages in order, progress and first readable pages."""
    listed = pages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "status", "warnings", "error", "updated_at"))).alias("pages"))
    return sessions.join(listed, "session_id", "left").join(progress(pages).select("session_id", "warnings_count"), "session_id", "left").join(first_readable(pages, sessions), "session_id", "left")


def queue_of(page_no: Column) -> Column:
    return F.when(page_no <= FIRST_PAGES, "page_high").otherwise("page_normal")


def to_enqueue(requested: DataFrame, pages: DataFrame, queued: DataFrame, force: bool = False) -> DataFrame:
    """session_id, page_no, queue, reset (the page failed before and is pending again) of requested pages that go to a queue.

    Pages that are ready or in work stay out, and so do queued ones: force doesn't change that, since a page already in the
    set of queued pages can't be added to it.
    """
    del force
    key = ["session_id", "page_no"]
    open_ = requested.select(*key).distinct().join(pages.select(*key, "status"), key).filter(~F.col("status").isin("ready", "processing"))
    return open_.join(queued.select(*key).distinct(), key, "left_anti").select(*key, queue_of(F.col("page_no")).alias("queue"), (F.col("status") == "failed").alias("reset"))


def around(views: DataFrame, window: int = 1) -> DataFrame:
    """session_id, page_no for the pages about the one in view (center), within the document."""
    lo, hi = F.greatest(F.lit(1), F.col("center") - window), F.least(F.col("page_count"), F.col("center") + window)
    return views.filter(lo <= hi).select("session_id", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("page_no")).distinct()


def report(diagnostics: DataFrame) -> DataFrame:
    """session_id and an array of items for each kind of diagnostic, in page order."""
    item = F.struct("page_no", "reason")
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, item))).alias(k)
    return diagnostics.groupBy("session_id").agg(*map(listed, KINDS))


def without_page(diagnostics: DataFrame, retried: DataFrame) -> DataFrame:
    """Diagnostics but for those of pages that are tried again."""
    return diagnostics.join(retried.select("session_id", "page_no").distinct(), ["session_id", "page_no"], "left_anti")


def switch_events(switches: DataFrame) -> DataFrame:
    """Events of failovers, one for each."""
    payload = F.to_json(F.struct("page_no", "from_provider", "to_provider", "reason"))
    return switches.select("session_id", F.lit("provider_switched").alias("event"), payload.alias("payload"))


def expiry(sessions: DataFrame, now: Column) -> DataFrame:
    """session_id, state: expired, expiring (five minutes or less are left) or live at a time."""
    soon = F.col("expires_at") <= now + F.make_interval(mins=F.lit(NOTICE_MINUTES))
    return sessions.select("session_id", F.when(F.col("expires_at") <= now, "expired").when(soon, "expiring").otherwise("live").alias("state"))


def swept(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions after a sweep: expired ones are tombstones, kept for two minutes from their end and then gone."""
    end = F.col("expires_at") + F.make_interval(secs=F.lit(TOMBSTONE_SECONDS))
    return sessions.withColumn("overall_status", F.when(F.col("expires_at") <= now, "expired").otherwise(F.col("overall_status"))).filter(end > now)


def page_events(changes: DataFrame) -> DataFrame:
    """The event of each change of a page: page_ready, page_failed, or progress."""
    kind = F.when(F.col("status") == "ready", "page_ready").when(F.col("status") == "failed", "page_failed").otherwise("progress")
    return changes.select("session_id", kind.alias("event"), F.to_json(F.struct("page_no", "status", "error")).alias("payload"), F.col("updated_at").alias("ts"))


def session_events(changes: DataFrame, pages: DataFrame, sessions: DataFrame, switches: DataFrame, now: Column) -> DataFrame:
    """session_id, event, payload of all seven kinds: of pages and progress, failovers, the end of sessions, and those that end soon."""
    none = F.lit(None).cast("string").alias("payload")
    final = final_status(pages).filter("final is not null").select("session_id", F.concat(F.lit("session_"), F.col("final")).alias("event"), F.to_json(F.struct(F.col("final").alias("status"))).alias("payload"))
    soon = expiry(sessions, now).filter("state = 'expiring'").select("session_id", F.lit("session_expiring").alias("event"), none)
    return page_events(changes).select("session_id", "event", "payload").unionByName(switch_events(switches)).unionByName(final).unionByName(soon)


def polled_version(previous: Column, updated_at: Column) -> Column:
    """The cache version of a page's image: the later of the one before and its last change in milliseconds."""
    return F.greatest(previous, F.coalesce(F.unix_millis(updated_at), F.lit(0)))
