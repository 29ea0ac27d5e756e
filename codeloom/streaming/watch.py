"""Watching changes: a leading-edge throttle, and micro-batches that update the graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SECONDS = 1.0
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def accepted(times: np.ndarray, last: float | None, seconds: float) -> tuple[np.ndarray, float | None]:
    """Which of the sorted times are accepted: those at least ``seconds`` after the last accepted one.

    Jumps from one accepted time to the next by binary search.
    """
    out = np.zeros(len(times), bool)
    at = 0 if last is None else _next(times, last, seconds, 0)
    while at < len(times):
        out[at], last = True, float(times[at])
        at = _next(times, last, seconds, at + 1)
    return out, last


def _next(times: np.ndarray, last: float, seconds: float, start: int) -> int:
    at = max(start, int(np.searchsorted(times, last + seconds)))
    while at > start and times[at - 1] - last >= seconds:  # the sum is rounded, the difference decides
        at -= 1
    while at < len(times) and times[at] - last < seconds:
        at += 1
    return at


def throttle(events: DataFrame, key: str = "key", ts: str = "ts", seconds: float = SECONDS) -> DataFrame:
    """The accepted events of (key, ts seconds). Each task walks over its sorted keys and holds one time."""
    ordered = events.select(key, ts).repartition(key).sortWithinPartitions(key, ts)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for b in batches:
            keys, times = b[key].to_numpy(), b[ts].to_numpy(np.float64)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            keep = np.zeros(len(keys), bool)
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                last = last if s == 0 and keys[0] == at else None
                keep[s:e], last = accepted(times[s:e], last, seconds)
                at = keys[s]
            yield b[keep]

    return ordered.mapInPandas(work, ordered.schema)


class _Throttle(StatefulProcessor):
    """A key's state is the time last accepted, until no event that it could hold back can come any more."""

    def __init__(self, key: str, ts: str, seconds: float):
        self.key, self.ts, self.seconds = key, ts, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        times = np.sort(np.concatenate([b[self.ts].to_numpy(np.float64) for b in rows]))
        keep, last = accepted(times, last, self.seconds)
        if last is not None:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(np.ceil((last + self.seconds) * 1000)))
        kept = times[keep]
        yield pd.DataFrame({self.key: pd.Series([key[0]] * len(kept), dtype=object), self.ts: pd.Series(kept, dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, key: str = "key", ts: str = "ts", seconds: float = SECONDS, late: str = "0 seconds") -> DataFrame:
    """The same over a stream (key, ts seconds); events more than ``late`` behind the newest are dropped.

    State expires by event time: once the watermark is ``seconds`` past a key's last accepted event, the key
    is forgotten. Needs the RocksDB state store, which the session names.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        raise ValueError(f"set {_PROVIDER} to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.select(F.col(key).cast("string").alias(key), F.col(ts).cast("double").alias(ts)).withColumn("_at", F.timestamp_seconds(ts)).withWatermark("_at", late)
    return timed.groupBy(key).transformWithStateInPandas(_Throttle(key, ts, seconds), f"{key} string, {ts} double", "append", "EventTime")


def watch(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Runs ``update`` on each micro-batch of changed files; the checkpoint makes restarts go on where they were."""
    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def tumbling(events: DataFrame, ts: str = "ts", width: str = "1 day") -> DataFrame:
    """Events counted by type and window; streams need a watermark set before."""
    w = F.window(F.col(ts), width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "2 hours") -> DataFrame:
    """Runs of a user's events without a gap."""
    w = F.session_window(F.col(ts), gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
