"""Resumable session fold: order-dependent signals kept in streaming state.

Any cut of the record stream into micro-batches gives the batch answer, as long
as the chunks of one transcript arrive in order.  State per session is a small
row plus the message ids seen.  With ``idle_hours``, the ids of a session are
dropped after so long without records; its totals stay, and a session that
changes later is reported with them for a batch recompute (``feeds.rebuild``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnwise import fixed
from turnwise.functions import text as X

STATE = (
    "human_turns BIGINT, interrupts BIGINT, denied_user BIGINT, denied_plan BIGINT, denied_auto BIGINT, steering BIGINT, "
    "lex_corrections BIGINT, first_correction_turn BIGINT, active_seconds DOUBLE, last_us BIGINT, first_us BIGINT, latest_us BIGINT, "
    "calls BIGINT, tokens BIGINT, next_line BIGINT"
)
FIELDS = [f.split()[0] for f in STATE.split(", ")]
OUTPUT = "path STRING, " + STATE + ", needs_recompute BOOLEAN"


def fold_input(records: DataFrame) -> DataFrame:
    """The narrow rows the fold reads; all text work stays outside Python."""
    u = F.col("usage")
    lex = F.col("is_human") & X.opens_like_correction(F.col("text"), F.lit(2))
    tokens = u["in_tokens"] + u["cc5"] + u["cc1h"] + u["cr"] + u["out"]
    return records.select(
        "path", "line_no", F.unix_micros("ts").alias("us"), F.col("ts_str").isNotNull().alias("has_ts"), "is_human",
        F.col("interrupt").isNotNull().alias("is_int"), "denial", "is_steering", F.coalesce(lex, F.lit(False)).alias("is_lex"),
        F.when(F.col("rtype") == "assistant", F.coalesce("msg_id", F.concat(F.lit("\0"), F.col("line_no").cast("string")))).alias("call"),
        F.coalesce(tokens, F.lit(0)).alias("tokens"), u.isNotNull().alias("has_usage"),
    )


def _advance(s: dict, rows: pd.DataFrame, fresh: pd.DataFrame) -> dict:
    """Add ordered rows to a state; vectorised, one call per chunk."""
    turn = s["human_turns"] + rows["is_human"].cumsum()
    before = turn - rows["is_human"]
    hard = rows["is_int"] | rows["is_steering"] | rows["denial"].isin(["user", "plan"])
    lex = rows["is_lex"] & (turn > 1)
    marks = before.where(hard, turn)[hard | lex].clip(lower=1)
    first = [v for v in [s["first_correction_turn"], marks.min() if len(marks) else None] if v is not None]

    timed = rows.loc[rows["has_ts"], "us"]
    chain = pd.concat([pd.Series([s["last_us"]], dtype="Float64"), timed.astype("Float64")], ignore_index=True)
    gaps = chain.diff().dropna() / 1e6
    seen = timed.dropna()
    firsts = [v for v in [s["first_us"], seen.min() if len(seen) else None] if v is not None]
    lasts = [v for v in [s["latest_us"], seen.max() if len(seen) else None] if v is not None]
    tail = timed.iloc[-1] if len(timed) else s["last_us"]
    used = fresh[fresh["has_usage"]]
    return {
        "human_turns": int(s["human_turns"] + rows["is_human"].sum()),
        "interrupts": int(s["interrupts"] + rows["is_int"].sum()),
        **{f"denied_{d}": int(s[f"denied_{d}"] + (rows["denial"] == d).sum()) for d in ("user", "plan", "auto")},
        "steering": int(s["steering"] + rows["is_steering"].sum()),
        "lex_corrections": int(s["lex_corrections"] + lex.sum()),
        "first_correction_turn": int(min(first)) if first else None,
        "active_seconds": float(s["active_seconds"] + gaps[(gaps > 0) & (gaps <= fixed.ACTIVE_GAP_SECONDS)].sum()),
        "last_us": None if pd.isna(tail) else int(tail),
        "first_us": int(min(firsts)) if firsts else None,
        "latest_us": int(max(lasts)) if lasts else None,
        "calls": int(s["calls"] + len(used)),
        "tokens": int(s["tokens"] + used["tokens"].sum()),
        "next_line": int(rows["line_no"].iloc[-1]) + 1,
    }


_EMPTY = {f: None if f in ("first_correction_turn", "last_us", "first_us", "latest_us") else 0 for f in FIELDS}


class SessionFold(StatefulProcessor):
    def __init__(self, idle_hours: float | None = None):
        self.idle_ms = None if idle_hours is None else int(idle_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", STATE)
        self.ids = handle.getMapState("ids", "id STRING", "line BIGINT")
        self.settled = handle.getValueState("settled", "next_line BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("line_no", kind="stable")
        if self.settled.exists():
            yield self._row(key, dict(zip(FIELDS, self.totals.get())), True)
            return
        s = dict(zip(FIELDS, self.totals.get())) if self.totals.exists() else dict(_EMPTY)
        late = bool((batch["line_no"] < s["next_line"]).any())
        batch = batch[batch["line_no"] >= s["next_line"]].drop_duplicates("line_no")
        if len(batch):
            calls = batch[batch["call"].notna()].drop_duplicates("call")
            known = pd.Series([self.ids.containsKey((c,)) for c in calls["call"]], index=calls.index, dtype=bool)
            fresh = calls[~known]
            for c, line in zip(fresh["call"], fresh["line_no"]):
                if not c.startswith("\0"):
                    self.ids.updateValue((c,), (int(line),))
            s = _advance(s, batch, fresh)
            self.totals.update(tuple(s[f] for f in FIELDS))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, s, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = dict(zip(FIELDS, self.totals.get())) if self.totals.exists() else dict(_EMPTY)
        self.ids.clear()
        self.settled.update((s["next_line"],))
        yield self._row(key, s, False)

    @staticmethod
    def _row(key, s: dict, recompute: bool) -> pd.DataFrame:
        row = pd.DataFrame([{"path": key[0], **s, "needs_recompute": recompute}])
        whole = [f for f in FIELDS if f != "active_seconds"]
        return row.astype({f: "Int64" for f in whole})

    def close(self) -> None:
        pass


STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_fold(records: DataFrame, idle_hours: float | None = None) -> DataFrame:
    """Updated totals of every session touched by a micro-batch.

    With ``idle_hours``, the timers make Spark plan batches without data.  A run that should
    end when the input is used up (``availableNow``) needs
    ``spark.sql.streaming.noDataMicroBatches.enabled=false``; timers that are
    due then fire with the next batch that has data.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    return fold_input(records).groupBy("path").transformWithStateInPandas(
        SessionFold(idle_hours), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime"
    )
