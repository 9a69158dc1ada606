"""Keyed state of sources: health folded from attempts, and silence found by a timer.

Both keep their state in RocksDB through ``transformWithStateInPandas``, one small record for each source, and so go on where they
were after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from homelens.operators.health import MAX_FAILURES, STALE_SECONDS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEALTH = "source string, attempts long, last_success_at timestamp, last_attempt_at timestamp, consecutive_failures long, status string, went_down_at timestamp"
SILENCE = "source string, state string, last_line_at timestamp"
NEVER = -(2**63)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB, which keyed state with timers and lists needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _time(micros: int) -> pd.Timestamp:
    return pd.NaT if micros == NEVER else pd.Timestamp(micros, unit="us")


class HealthState(StatefulProcessor):
    """The failure streak, the last success and the status of a source."""

    def __init__(self, stale: int, most: int):
        self.stale, self.most = stale * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "attempts long, success long, attempt long, failures long, status string")
        self.failed = handle.getListState("failed", "at long")

    def _status(self, success: int, failures: int, now: int) -> str:
        if success == NEVER or failures >= self.most:
            return "down"
        return "degraded" if failures or now - success >= self.stale else "ok"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, success, attempt, failures, status = self.record.get() if self.record.exists() else (0, NEVER, NEVER, 0, "down")
        found, fresh = [], []
        tries = sorted((t, ok) for frame in rows for t, ok in zip(frame["micros"], frame["ok"], strict=True))
        for at, ok in tries:
            before, count = status, count + 1
            if ok and at >= success:
                success = at
                if at >= attempt:
                    fresh, failures = [], 0
                    self.failed.clear()
                else:  # a late success: failures after it still count
                    fresh = [t for t in [*(x[0] for x in self.failed.get()), *fresh] if t > at]
                    failures = len(fresh)
                    self.failed.clear()
            elif not ok and at > success:
                failures += 1
                fresh.append(at)
            attempt = max(attempt, at)
            status = self._status(success, failures, attempt)
            if status == "down" and before != "down":
                found.append((count, success, attempt, failures, status, at))
        if fresh:
            self.failed.appendList([(t,) for t in fresh])
        self.record.update((count, success, attempt, failures, status))
        found.append((count, success, attempt, failures, status, NEVER))
        yield pd.DataFrame([(key[0], c, _time(s), _time(a), f, st, _time(d)) for c, s, a, f, st, d in found], columns=["source", "attempts", "last_success_at", "last_attempt_at", "consecutive_failures", "status", "went_down_at"])


def source_health(attempts: DataFrame, stale: int = STALE_SECONDS, most: int = MAX_FAILURES) -> DataFrame:
    """Health of each source (HEALTH) after each batch of ``attempts`` (source, tried_at, ok), and one row more for each time that
    it goes down from ok or degraded, with went_down_at.

    Attempts of a batch count in the order of their times. A late attempt counts as the batch fold ``health.source_health`` counts it: a
    failure before the last success is none, and a late success ends the failures before it. The row with the most ``attempts`` and
    no went_down_at is a source's last state. Use with output mode ``append``.
    """
    use_rocksdb(attempts.sparkSession)
    timed = attempts.select("source", "ok", F.unix_micros(F.col("tried_at").cast("timestamp")).alias("micros"))
    return timed.groupBy("source").transformWithStateInPandas(HealthState(stale, most), HEALTH, "Append", "None")


class SilenceState(StatefulProcessor):
    """The time of a source's last line, and a timer that fires when it is ``stale`` seconds without one."""

    def __init__(self, stale: int):
        self.stale = stale * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "last long, silent boolean")

    def _row(self, key, state: str, last: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], state, _time(last))], columns=["source", "state", "last_line_at"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, silent = self.record.get() if self.record.exists() else (NEVER, True)
        last = max([last, *(int(t) for frame in rows for t in frame["micros"])])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale)
        self.record.update((last, False))
        if silent:
            yield self._row(key, "heard", last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, silent = self.record.get()
        self.record.update((last, True))
        if not silent:
            yield self._row(key, "silent", last)


def silence(lines: DataFrame, stale: int = STALE_SECONDS) -> DataFrame:
    """(source, state, last_line_at): ``heard`` with a source's first line and its first one after silence, ``silent`` once
    when it is ``stale`` seconds of processing time without a line of ``lines`` (source, seen_at). Use with output mode ``append``."""
    use_rocksdb(lines.sparkSession)
    timed = lines.select("source", F.unix_micros(F.col("seen_at").cast("timestamp")).alias("micros"))
    return timed.groupBy("source").transformWithStateInPandas(SilenceState(stale), SILENCE, "Append", "ProcessingTime")
