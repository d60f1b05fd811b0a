"""Sign-in outcomes as a stream with state: what ops.sign_in_replay() gives for all attempts at once, as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "event_id long, user_id long, ts_seconds long, outcome string"


class Attempts(StatefulProcessor):
    """Of one user: failures so far and the end of a lock, and attempts that wait for the watermark to pass them.

    Attempts are judged in the order of their times and ids, not of their arrival: each waits until its time is complete, when a timer
    wakes the user. What waits is bounded by the watermark's delay.
    """

    def __init__(self, most: int, minutes: int):
        self.most, self.seconds = most, 60 * minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "failed int, until long")
        self.waiting = handle.getListState("waiting", "at_ms long, ts_seconds long, event_id long, good boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(t), int(e), bool(g)) for pdf in rows for a, t, e, g in zip(pdf["at_ms"], pdf["ts_seconds"], pdf["event_id"], pdf["good"])]
        self.waiting.appendList(new)
        known = set(self.handle.listTimers())
        for at in sorted({r[0] for r in new} - known):
            self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] <= now]
        failed, until = self.account.get() if self.account.exists() else (0, -(1 << 62))
        out = []
        for _, at, event, good in sorted(due, key=lambda r: (r[1], r[2])):
            if at < until:
                outcome = "locked"
            elif good:
                failed, outcome = 0, "ok"
            else:
                failed, outcome = failed + 1, "failed"
                if failed >= self.most:
                    failed, until = 0, at + self.seconds
            out.append((event, key[0], at, outcome))
        self.account.update((failed, until))
        left = rows[len(due) :]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["event_id", "user_id", "ts_seconds", "outcome"])

    def close(self) -> None:
        pass


def sign_ins(attempts: DataFrame, most: int = 5, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, ts_seconds, outcome) of a stream of attempts (event_id, user_id, created_at, good), once the watermark has passed them.

    Attempts that come later than `late` are not judged. Needs the RocksDB state store, which is set here.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    at = F.unix_millis(F.col("created_at").cast("timestamp"))
    rows = attempts.select("event_id", "user_id", F.col("created_at").cast("timestamp").alias("created_at"), F.floor(at / 1000).alias("ts_seconds"), at.alias("at_ms"), "good").withWatermark("created_at", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Attempts(most, minutes), outputStructType=OUT, outputMode="append", timeMode="eventTime")
