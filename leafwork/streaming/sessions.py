"""Sessions as streams: page changes in, page states, events and expiry out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans import sessions as S

EVENT = "session_id string, event string, ts timestamp"


class Expiry(StatefulProcessor):
    """A notice once when five minutes are left, an end once when none are, and then the state is gone.

    Input rows: session_id, expires_at. A later row for a session moves its end; one for a session that has ended starts anew.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "end_ms long, noticed boolean")

    def _arm(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        end, noticed = self.end.get()
        notice = end - S.NOTICE_MINUTES * 60_000
        self.handle.registerTimer(max(now + 1, end if noticed else notice))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = max(int(r["expires_at"].max().timestamp() * 1000) for r in rows)
        self.end.update((end, False))
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        yield self._rows([], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.end.exists():
            end, noticed = self.end.get()
            if now >= end:
                self.end.clear()
                yield self._event(key, "session_expired", end)
            elif not noticed:
                self.end.update((end, True))
                self._arm(now)
                yield self._event(key, "session_expiring", end)

    @staticmethod
    def _event(key, event: str, ms: int) -> pd.DataFrame:
        return Expiry._rows([key[0]], [event], [pd.Timestamp(ms, unit="ms")])

    @staticmethod
    def _rows(ids: list, events: list, times: list) -> pd.DataFrame:
        return pd.DataFrame({"session_id": pd.Series(ids, dtype=object), "event": pd.Series(events, dtype=object), "ts": pd.Series(times, dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def expiry_events(sessions: DataFrame) -> DataFrame:
    """session_expiring and session_expired of a stream of sessions (session_id, expires_at)."""
    return sessions.groupBy("session_id").transformWithStateInPandas(Expiry(), EVENT, "Update", "ProcessingTime")


def page_states(changes: DataFrame) -> DataFrame:
    """The running state of each page of a stream of changes, in update or complete mode."""
    return S.latest_pages(changes, ["updated_at", "change_id"])


def windowed_progress(changes: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Changes by status in windows of event time; later ones than ``late`` are left out."""
    return changes.withWatermark("updated_at", late).groupBy(F.window("updated_at", width), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def feed(changes: DataFrame) -> DataFrame:
    """The events that a stream of page changes publishes."""
    return S.page_events(changes)


def fold_into(store_path: str):
    """For foreachBatch: page states as a table, merged batch by batch.

    A batch that is run again gives the same table: its folder is named by the batch, and the newest complete one counts.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = S.latest_pages(batch, ["updated_at", "change_id"])
        if batch_id > 0:
            # A gap is an error: what was folded before would be lost without a word.
            old = spark.read.parquet(f"{store_path}/batch={batch_id - 1}")
            both = old.withColumn("change_id", F.lit(-1).cast("long")).unionByName(new.withColumn("change_id", F.lit(0).cast("long")))
            new = S.latest_pages(both, ["updated_at", "change_id"])
        new.write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")

    return merge
