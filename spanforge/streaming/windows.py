"""The rate counter and gap sessions over streams: the same rows as in batch over what has come.

The watermark is an addition: it bounds the state by event time and drops what comes later than it allows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def hourly_attempts(events: DataFrame, who: str = "user_id", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """who, win (hours since 1970), n of a stream of attempts with a timestamp."""
    w = events.withWatermark(time, late).groupBy(who, F.window(time, "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select(who, F.floor(F.unix_micros("w.start") / 3_600_000_000).cast("long").alias("win"), "n")


_OPEN = ["user_id", "kind", "start_us", "end_us", "n", "last_us"]


class _Sessions(StatefulProcessor):
    """The open sessions of a bucket of users are its state: user, kind, start, end, rows, and the end of the last row. A timer
    closes the first of them once the watermark is past that end and the gap."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "user_id long, kind string, start_us long, end_us long, n long, last_us long")

    def _held(self) -> pd.DataFrame:
        held = list(self.open.get()) if self.open.exists() else []
        return pd.DataFrame(held, columns=_OPEN).astype({c: "int64" for c in _OPEN if c != "kind"})

    def _hold(self, held: pd.DataFrame, least_ms: int) -> None:
        self.open.put(list(held.astype({"kind": object}).itertuples(index=False, name=None)))
        self.handle.registerTimer(max((int(held.last_us.min()) + self.gap_us) // 1000 + 1, least_ms))

    @staticmethod
    def _given(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        out = found[_OPEN[:5]]
        return out.assign(user_id=pd.Series(None, index=out.index, dtype="Int64")) if key[0] < 0 else out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat([r[["user_id", "kind", "us", "e"]] for r in rows])
        x = x.assign(new=True, end_us=x.e, n=1)
        if key[0] < 0:
            x["user_id"] = 0
        held = self._held()
        met = held.user_id.isin(x.user_id)
        if met.any():  # a user's open session goes before the rows of now
            x = pd.concat([held[met].rename(columns={"start_us": "us", "last_us": "e"}).assign(new=False), x])
        x = x.sort_values(["user_id", "new", "us", "e"], kind="stable")
        # rows of a session are numbered by how many breaks lie before them
        breaks = (x.user_id != x.user_id.shift()) | (x.kind != x.kind.shift()) | (x.us - x.e.shift() > self.gap_us)
        found = x.groupby(breaks.cumsum().to_numpy()).agg(user_id=("user_id", "first"), kind=("kind", "first"), start_us=("us", "first"), end_us=("end_us", "max"), n=("n", "sum"), last_us=("e", "last"))
        over = found.user_id.duplicated(keep="last")
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        still = found[~over]
        self._hold(still if met.all() else pd.concat([held[~met], still]), timerValues.getCurrentWatermarkInMs() + 1)
        yield self._given(key, found[over])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self._held(), timerValues.getCurrentWatermarkInMs()
        over = (held.last_us + self.gap_us) // 1000 + 1 <= now
        if over.all():
            self.open.clear()
        else:
            self._hold(held[~over], now + 1)
        yield self._given(key, held[over])

    def close(self) -> None:
        pass


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep state in a store that can hold timers and more than fits in memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def gap_sessions(events: DataFrame, gap_us: int, late: str = "0 seconds", buckets: int = 256) -> DataFrame:
    """user_id, kind, start_us, end_us, n of the sessions of a stream (user_id, kind, ts, us, e) in time order per user; the
    stream has to start within keyed_state.

    A session ends where the kind changes or more than gap_us lies between the end of its last row and the next start,
    as in batch, however rows fall into micro-batches. Only a user's open session is held, and given out when the watermark
    is past it. Rows of a micro-batch are put in order first; `late` says for how long rows may come late before they
    are dropped. Users share `buckets` states, as calls of Python for each user take far longer than its rows do: a call
    holds the open sessions and the rows of a micro-batch of one bucket, so take more buckets for larger micro-batches."""
    fields = "user_id long, kind string, start_us long, end_us long, n long"
    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    return events.withWatermark("ts", late).withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Sessions(gap_us), outputStructType=fields, outputMode="append", timeMode="EventTime")
