"""Sessions over tables in a folder: what a caller can ask for, with states kept as rows that are only appended.

Every change is a new file of rows (session, page, change), so writers need no locks, and no update is lost. What holds now is
the latest row of each key. Answers are small: one session at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import Settings
from . import sessions as S

_CHANGES = "session_id string, page_no int, status string, warnings array<string>, error string, updated_at timestamp, change_id long"
_META = "session_id string, overall_status string, page_count int, created_at timestamp, expires_at timestamp, change_id long"
_QUEUE = "session_id string, page_no int, queue string, queued boolean, change_id long"
_DIAGNOSTICS = "session_id string, page_no int, kind string, reason string, change_id long, cleared boolean"

_MEMORY = "session_id string, fp string, translation string, change_id long, cleared boolean"


class NotFoundError(KeyError):
    """404"""


class ConflictError(RuntimeError):
    """409"""


@dataclass
class Service:
    spark: SparkSession
    root: str
    settings: Settings = Settings()
    clock: object = None

    def now(self) -> datetime:
        return self.clock() if self.clock else datetime.now(UTC).replace(tzinfo=None)

    def _id(self) -> int:
        """Grows with time, also between processes; of two at one instant either may count."""
        return int(datetime.now(UTC).timestamp() * 1e6)

    def _append(self, table: str, rows: list[tuple] | DataFrame, schema: str) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").partitionBy("session_id").parquet(f"{self.root}/{table}")

    def _read(self, table: str, schema: str, session_id: str | None = None) -> DataFrame:
        path = f"{self.root}/{table}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(path)
        return df.filter(F.col("session_id") == session_id) if session_id else df

    # Reading

    def meta(self, session_id: str) -> dict:
        row = self._read("meta", _META, session_id).orderBy(F.desc("change_id")).first()
        if row is None or row["overall_status"] in ("deleted", "expired"):
            raise NotFoundError(session_id)
        return row.asDict()

    def pages(self, session_id: str) -> DataFrame:
        out = S.latest_pages(self._read("pages", _CHANGES, session_id), ["updated_at", "change_id"])
        return out.withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))

    def state(self, session_id: str) -> dict:
        meta = self.meta(session_id)
        sessions = self.spark.createDataFrame([tuple(meta[k] for k in ("session_id", "overall_status", "page_count", "created_at", "expires_at"))], _META.rpartition(",")[0])
        return S.session_state(sessions, self.pages(session_id)).first().asDict(recursive=True)

    def queue(self, session_id: str) -> DataFrame:
        rows = self._read("queue", _QUEUE, session_id)
        last = rows.groupBy("session_id", "page_no").agg(F.max_by(F.struct("queue", "queued"), "change_id").alias("q"))
        return last.filter("q.queued").select("session_id", "page_no", "q.queue")

    def diagnostics(self, session_id: str) -> DataFrame:
        rows = self._read("diagnostics", _DIAGNOSTICS, session_id)
        cleared = rows.filter("cleared").groupBy("session_id", "page_no").agg(F.max("change_id").alias("until"))
        return rows.filter("not cleared").join(cleared, ["session_id", "page_no"], "left").filter(F.col("until").isNull() | (F.col("change_id") > F.col("until"))).drop("until")

    def report(self, session_id: str) -> dict:
        self.meta(session_id)
        row = S.report(self.diagnostics(session_id)).first()
        return {k: [x.asDict() for x in row[k]] if row else [] for k in S.KINDS}

    def memory(self, session_id: str) -> DataFrame:
        """session_id, fp, translation: what the session has learnt since its memory was last cleared."""
        rows = self._read("memory", _MEMORY, session_id)
        cleared = rows.filter("cleared").groupBy("session_id").agg(F.max("change_id").alias("until"))
        kept = rows.filter("not cleared").join(cleared, "session_id", "left").filter(F.col("until").isNull() | (F.col("change_id") > F.col("until")))
        return kept.groupBy("session_id", "fp").agg(F.max_by("translation", "change_id").alias("translation"))

    def events(self, session_id: str) -> DataFrame:
        """session_id, event, payload: all that a listener of the session is told, of all seven kinds."""
        meta = self.meta(session_id)
        one = self.spark.createDataFrame([(session_id, meta["expires_at"])], "session_id string, expires_at timestamp")
        moved = self.diagnostics(session_id).filter("kind = 'provider_switched'")
        ends = F.split("reason", ">", 2)
        switches = moved.select("session_id", "page_no", ends[0].alias("from_provider"), F.get(ends, F.lit(1)).alias("to_provider"), F.lit("failover").alias("reason"))
        return S.session_events(self._read("pages", _CHANGES, session_id), self.pages(session_id), one, switches, F.lit(self.now()))

    # Changing

    def _set(self, meta: dict, status: str) -> None:
        self._append("meta", [(meta["session_id"], status, meta["page_count"], meta["created_at"], meta["expires_at"], self._id())], _META)

    def create(self, page_count: int) -> dict:
        session_id, now = uuid.uuid4().hex, self.now()
        one = self.spark.createDataFrame([(session_id, page_count, now)], "session_id string, page_count int, created_at timestamp")
        sessions, pages = S.create(one, self.settings.session_ttl_minutes)
        stamp = F.lit(self._id())
        self._append("meta", sessions.withColumn("change_id", stamp), _META)
        self._append("pages", pages.withColumn("change_id", stamp), _CHANGES)
        return self.meta(session_id)

    def start(self, session_id: str) -> dict:
        """Queues all pages, the first three with priority. A session that runs or is ready stays as it is."""
        meta = self.meta(session_id)
        first = list(range(1, min(S.FIRST_PAGES, meta["page_count"]) + 1))
        if meta["overall_status"] in ("running", "ready"):
            return {"status": meta["overall_status"], "priority_pages": first}
        self._set(meta, "running")
        self._enqueue(session_id, self.pages(session_id))
        return {"status": "running", "priority_pages": first}

    def _enqueue(self, session_id: str, requested: DataFrame) -> list[int]:
        rows = S.to_enqueue(requested, self.pages(session_id), self.queue(session_id)).orderBy("page_no").collect()
        stamp = self._id()
        if rows:
            self._append("queue", [(session_id, r["page_no"], r["queue"], True, stamp) for r in rows], _QUEUE)
        if again := [r["page_no"] for r in rows if r["reset"]]:
            self._append("pages", [(session_id, p, "pending", None, None, self.now(), stamp) for p in again], _CHANGES)
        return [r["page_no"] for r in rows]

    def ensure(self, session_id: str, center: int, window: int = 1) -> list[int]:
        """Queues the page in view and its neighbours."""
        meta = self.meta(session_id)
        if not 1 <= center <= meta["page_count"]:
            raise NotFoundError(center)
        if meta["overall_status"] == "created":
            raise ConflictError("session not started")
        if not 0 <= window <= 3:
            raise ValueError("window must be 0 to 3")
        view = self.spark.createDataFrame([(session_id, center, meta["page_count"])], "session_id string, center int, page_count int")
        return self._enqueue(session_id, S.around(view, window))

    def page(self, session_id: str, page_no: int, status: str, warnings: list[str] | None = None, error: str | None = None) -> str | None:
        """A page's new state; done pages leave the queue. The session's final status once all pages are done."""
        if status not in S.STATUSES:
            raise ValueError(status)
        meta, stamp = self.meta(session_id), self._id()
        if not 1 <= page_no <= meta["page_count"]:
            raise NotFoundError(page_no)
        self._append("pages", [(session_id, page_no, status, warnings, error, self.now(), stamp)], _CHANGES)
        if status not in ("ready", "failed"):
            return None
        self._append("queue", [(session_id, page_no, None, False, stamp)], _QUEUE)
        final = S.final_status(self.pages(session_id)).first()["final"]
        if final:
            self._set(meta, final)
        return final

    def diagnose(self, session_id: str, rows: list[tuple[int, str, str]]) -> None:
        """rows: page_no, kind, reason."""
        stamp = self._id()
        self._append("diagnostics", [(session_id, p, k, r, stamp, False) for p, k, r in rows], _DIAGNOSTICS)

    def remember(self, session_id: str, translations: dict[str, str]) -> None:
        """Translations by fingerprint; empty ones aren't kept."""
        self.meta(session_id)
        stamp = self._id()
        if rows := [(session_id, fp, t, stamp, False) for fp, t in translations.items() if t]:
            self._append("memory", rows, _MEMORY)

    def switched(self, session_id: str, page_no: int, before: str, after: str) -> None:
        """A failover from one provider to another."""
        self.diagnose(session_id, [(page_no, "provider_switched", f"{before}>{after}")])

    def retry(self, session_id: str, page_no: int) -> str:
        """A page again: its diagnostics and the session's memory are cleared; queued, or skipped if it is queued already."""
        meta = self.meta(session_id)
        if not 1 <= page_no <= meta["page_count"]:
            raise NotFoundError(page_no)
        if meta["overall_status"] == "created":
            raise ConflictError("session not started")
        stamp = self._id()
        self._append("diagnostics", [(session_id, page_no, "", "", stamp, True)], _DIAGNOSTICS)
        self._append("memory", [(session_id, None, None, stamp, True)], _MEMORY)
        self._append("pages", [(session_id, page_no, "pending", None, None, self.now(), stamp)], _CHANGES)
        one = self.spark.createDataFrame([(session_id, page_no)], "session_id string, page_no int")
        return "queued" if self._enqueue(session_id, one) else "skipped"

    def delete(self, session_id: str) -> None:
        """Always succeeds; what is left is a tombstone."""
        try:
            self._set(self.meta(session_id), "deleted")
        except NotFoundError:
            pass

    def sweep(self) -> list[str]:
        """Sessions that have expired by now; each is told once."""
        last = self._read("meta", _META).groupBy("session_id").agg(F.max_by(F.struct("overall_status", "page_count", "created_at", "expires_at"), "change_id").alias("m")).select("session_id", "m.*")
        gone = last.filter(~F.col("overall_status").isin("deleted", "expired") & (F.col("expires_at") <= F.lit(self.now()))).collect()
        for r in gone:
            self._set(r.asDict(), "expired")
        return sorted(r["session_id"] for r in gone)
