"""Closed sessions as one stream: idle for long enough, or continued elsewhere, whichever comes first, once per session.

A timer of event time stands at a session's latest record plus ``idle``; every later record moves it.  It fires when the watermark passes it, so
neither the clock nor the order of arrival (within the watermark's delay) decides.  A record that says where the session goes on closes it
at once and takes the timer away.  What comes after is not a second closing; a closed session keeps one flag of state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnwise.streaming.fold import STATE_PROVIDER

OUTPUT = "path STRING, cause STRING, continued_in STRING, latest_us BIGINT, n_records BIGINT"
IDLE, CONTINUED = "idle", "continued"


class Closing(StatefulProcessor):
    def __init__(self, idle_hours: float):
        self.idle_ms = int(idle_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "latest_us BIGINT, n_records BIGINT, closed BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, n, closed = self.session.get() if self.session.exists() else (None, 0, False)
        target, at = None, None
        for frame in rows:
            n += len(frame)
            seen = frame["us"].dropna()
            if len(seen):
                latest = int(seen.max()) if latest is None else max(latest, int(seen.max()))
            onward = frame[frame["continued_in"].notna()]
            if len(onward):  # several say so: the last by line counts
                last = onward.loc[onward["line_no"].idxmax()]
                if at is None or last["line_no"] > at:
                    target, at = last["continued_in"], last["line_no"]
        if not closed:
            self._drop_timers()
            if target is not None:
                closed = True
                yield self._row(key, CONTINUED, target, latest, n)
            elif latest is not None:
                self.handle.registerTimer(latest // 1000 + self.idle_ms)
        self.session.update((latest, n, closed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        latest, n, closed = self.session.get()
        if not closed:
            self.session.update((latest, n, True))
            yield self._row(key, IDLE, None, latest, n)

    def _drop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    @staticmethod
    def _row(key, cause: str, target: str | None, latest: int | None, n: int) -> pd.DataFrame:
        row = pd.DataFrame([{"path": key[0], "cause": cause, "continued_in": target, "latest_us": latest, "n_records": n}])
        return row.astype({"latest_us": "Int64"})

    def close(self) -> None:
        pass


def stream_closed(records: DataFrame, idle_hours: float = 6, watermark: str = "1 hour") -> DataFrame:
    """(path, cause, continued_in, latest_at, n_records) of every session when it closes."""
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    onward = F.when(F.col("rtype") == "continued-in", F.col("continued_in"))
    narrow = records.withWatermark("ts", watermark).select("path", "ts", "line_no", F.unix_micros("ts").alias("us"), onward.alias("continued_in"))
    closed = narrow.groupBy("path").transformWithStateInPandas(Closing(idle_hours), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")
    return closed.select("path", "cause", "continued_in", F.timestamp_micros("latest_us").alias("latest_at"), "n_records")
